"""Nulls in every column, empty and long texts, repeats, empty tables, clashing names: each
operator against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import byte_bpe, exact_dedup, html_extract, language_id, line_dedup, mixing, near_dedup, quality, sharding, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))
ROWS = [
    (1, "Hello  world\nsame line\nsame line", "en", "a"), (2, "Hello world same\tline same line", "en", "a"), (3, None, None, None), (4, "", "de", "b"), (5, " \n\t\x0b\r ", "de", None), (6, LONG, "en", "b"), (7, LONG + " ", "en", "a"),
    (7, LONG + " ", "en", "a"), (8, "one", None, "c"), (None, "one", "fr", "c"), (None, None, "fr", None), (9, "a b c a b c a b c x y", "fr", "é"), (10, "<|endoftext|> Straße ÉCOLE 日本 😀 don't", "de", "c"), (11, "x" * 5000, "en", "a"), (12, "12 34 !!", "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
# Names that the operators use themselves.
CLASH = {"id": 1, "row": 2, "keep": 3, "kept": True, "size": 4, "n": 5, "key": 6, "rep": 7, "norm": "x", "words": "y", "shard": 8, "copies": 9, "host": "h", "stratum": "s"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (6, None, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    want = []
    for i, t, _, _ in ROWS:
        w = WORD.findall(t or "")
        g = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j + o for j in range(len(w) - 2) if g[tuple(w[j : j + 3])] > 1 for o in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        bad = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), bad, not bad))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    same([tuple(r) for r in quality.quality_rules(docs, labels).select(cols).collect()], want)
    assert quality.quality_rules(empty, labels).count() == 0 and quality.quality_rules(docs, labels.limit(0)).count() == len(ROWS)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(w[-1] for w in want)


def test_binomial_tail_is_exact(spark):
    from fractions import Fraction

    cases = [(k, n) for n in (1, 2, 7, 60, 400, 1500) for k in (0, 1, 3, 10, n // 2, n) if k <= n]
    got = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality.binomial_tail(F.col("k"), F.col("n"), 0.0625)).collect()
    for r in got:
        p = Fraction(1, 16)
        exact = float(sum(comb(r["n"], i) * p**i * (1 - p) ** (r["n"] - i) for i in range(r["k"] + 1)))
        assert r["p"] == 1.0 if r["k"] >= r["n"] / 16 else abs(r["p"] - exact) <= 1e-9 * exact


def test_cutoffs_are_certified(spark):
    # 3000 good documents, 2 of them with many symbols; 500 bad ones with many.
    good = [(i, "plain words here " * 20 if i >= 2 else "## ## word " * 30, "en", "s") for i in range(3000)]
    bad = [(i, "**** %%%% text " * 30, "en", "s") for i in range(3000, 3500)]
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)) + (" ####" * 60 if i < 2 else ""), a, b) for i, _, a, b in good]
    bad = [(i, " ".join(f"w{i}x{j} **%%%%%%%%" for j in range(60)), a, b) for i, _, a, b in bad]
    df = spark.createDataFrame(good + bad, SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 3000)) for i in range(3500)], "doc_id long, quality int")
    out = quality.quality_rules(df, labels).where("not kept").select("doc_id").collect()
    gone = {r[0] for r in out}
    assert gone >= set(range(3000, 3500)) and len(gone) <= 500 + 60


@pytest.mark.parametrize("parts", ["4", "40"])
def test_exact_dedup(spark, docs, empty, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)  # with 40, frequent texts are salted
    try:
        many = docs.select("doc_id", "text").unionByName(spark.range(100, 400).selectExpr("id as doc_id", "'hot   text' as text")).unionByName(spark.range(400, 500).selectExpr("id as doc_id", "concat('t', id % 7) as text"))
        rows = [(r[0], re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")) for r in many.collect()]
        groups = defaultdict(list)
        for i, t in rows:
            groups[t].append(i)
        got = exact_dedup.content_sort(many).collect()
        least = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
        same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], [(i, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows])
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
        dropped = exact_dedup.drop_copies(docs)
        assert dropped.columns == docs.columns and dropped.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _, _ in ROWS})
        assert exact_dedup.content_sort(empty).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_near_dedup_rows(docs, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()), key=repr)
    find = {(r[0], r[2]) for r in got}
    assert len(got) == len(ROWS) and {(6, 6), (7, 6), (3, 3), (4, 4), (8, 8), (None, None)} <= find
    assert all(r[3] == (r[0] == r[2]) for r in got) and next(r for r in got if r[0] == 8)[1] == 1 and next(r for r in got if r[0] == 3)[1] == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.drop_near_copies(docs).columns == docs.columns


def test_near_dedup_against_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(9)
    monkeypatch.setattr(near_dedup, "SMALL", 4)  # so that buckets are refined
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(260):
        w = list(base) if i < 160 else [f"r{rng.randint(0, 400)}" for _ in range(rng.choice([3, 5, 30, 60]))]
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(["edit", f"e{rng.randint(0, 20)}"])
        if rng.random() < 0.2:
            w = w[: rng.randint(1, len(w))]
        rows.append((i, " ".join(w).upper() if i % 3 else "  ".join(w)))
    rows += [(1000 + k, rows[k][1]) for k in range(0, 200, 9)]
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], [(i, len(sets[i]), find(i)) for i in ids])


def test_token_counts(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _, _ in ROWS]
    got = token_counts.count_tokens(docs).collect()
    same([tuple(r)[:3] for r in got], want)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and token_counts.count_tokens(empty).count() == 0


def test_token_counts_fuzz():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_counts.VOCABULARY)
    t, mine, rng = Tokenizer.from_file(path), token_counts.WordCounts(path), random.Random(4)
    bits = ["a", "É", "Σ", "ς", "ß", "İ", "é", " ", "\n", "\x1c", "\x85", " ", "'s", "'LL", "<|endoftext|>", "<|", "日本", "😀", "½", "٣", "x" * 70, "123", "%%", "ﬁ"]
    for _ in range(1500):
        x = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert mine.count(x) == len(t.encode(x, add_special_tokens=False).ids), x


def test_byte_bpe(spark, docs, empty):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    want = [(i, lib.encode_ordinary(x or "")) for i, x, _, _ in ROWS]
    got = byte_bpe.encode(docs).collect()
    same([(r.doc_id, r.n_tokens, r.ids) for r in got], [(i, len(x), x) for i, x in want])
    texts = Counter((x or "").encode() for _, x, _, _ in ROWS)
    assert Counter(bytes(r.decoded) for r in got) == texts
    assert Counter(r.decoded_sha256 for r in got) == Counter({hashlib.sha256(t).hexdigest(): n for t, n in texts.items()})
    assert {r.ids_sha256 for r in got} == {hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in x)).hexdigest() for _, x in want}
    assert byte_bpe.encode(empty).count() == 0
    words = ["", " the", " internationalization", "日本語", "aaaaaaaaaa", " xq7#", "é"]
    coded = byte_bpe.decode_words(byte_bpe.encode_words(spark.createDataFrame([(w.encode(),) for w in words] + [(None,)], "word binary"), path)).collect()
    for r in coded:
        assert (r.ids is None) if r.word is None else (r.ids == lib._encode_single_piece(bytes(r.word)) if r.word else r.ids == []) and bytes(r.decoded) == bytes(r.word)


def test_language_id(spark, docs, empty):
    parts = {"en": "the of and that with this ing ed", "de": "der und nicht mit eine ung lich keit", "fr": "le la les des pour avec tion eau"}
    import random

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(parts[k].split(), k=rng.randint(4, 60))), k) for i in range(900) for k in [rng.choice(list(parts))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    out = language_id.identify(df, model).join(df, "doc_id").where("held_out")
    assert out.count() > 100 and out.where("lang = lang_pred").count() >= 0.97 * out.count()
    again = language_id.fit(df.repartition(7))
    assert (again.table == model.table).all()
    got = {(r.doc_id, r.lang_pred == "und") for r in language_id.identify(docs, model).collect()}
    assert {(3, True), (4, True), (5, True), (12, True), (1, False), (None, True), (None, False)} <= got
    assert all(0 <= r.score <= 1 for r in language_id.identify(docs, model).collect())
    assert language_id.identify(empty, model).count() == 0 and language_id.fit(empty) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_line_dedup(spark, docs, empty):
    rows = [(i, f"own {i}\n  shared footer \nlocal {i % 3}", f"site{i}") for i in range(12)] + [(50 + i, f"own b{i}\nrepeated", "site0") for i in range(30)] + [(90, None, None), (91, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_dedup.drop_lines(df).collect()}
    assert got[0].text == "own 0\nlocal 0" and got[0].n_removed == 1 and got[0].n_lines == 3
    assert got[50].text == "own b0\nrepeated" and got[90].text == "" and got[91].n_lines == 0
    assert line_dedup.drop_lines(empty).count() == 0 and line_dedup.drop_lines(docs).count() == len(ROWS)


def test_mixing(spark, docs, empty):
    rows = [(i, "w " * (i % 40), s) for i in range(3000) for s in ["big" if i % 3 else ("mid" if i % 2 else None)]] + [(None, "a b", "tiny"), (5000, "", "void")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan_mix(df).collect()
    total = sum(len(WORD.findall(t)) for _, t, _ in rows)
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0 for r in got)
    targets = {(r.source_size, r.target) for r in got}
    assert abs(sum(t for _, t in targets) - total) < 1e-6 and all(t <= 3 * s for s, t in targets)
    taken = Counter()
    for r in got:
        taken[r.source_size] += r.taken
    assert all(abs(taken[s] - t) <= 120 for s, t in targets)
    same([tuple(r) for r in got], [tuple(r) for r in mixing.plan_mix(df.repartition(5)).collect()])
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == mixing.plan_mix(docs).agg(F.sum("copies")).first()[0]
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_targets_against_resharing(spark):
    import random

    rng = random.Random(6)
    for _ in range(6):
        sizes = {f"s{i:02}": rng.choice([1, 3, 50, 4000, 90_000]) for i in range(rng.randint(1, 12))}
        total, names = sum(sizes.values()), sorted(sizes)
        weight = {s: i % 3 + 1 for i, s in enumerate(names)}
        full: set[str] = set()
        while True:  # share by weight; whoever is above the limit stops there, the rest is shared anew
            rest = total - sum(3 * sizes[s] for s in full)
            open_ = [s for s in names if s not in full]
            want = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = {s for s in open_ if want[s] > 3 * sizes[s]}
            if not over:
                break
            full |= over
        want |= {s: 3.0 * sizes[s] for s in full}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert all(abs(r.target - want[r.source]) <= 1e-6 * total for r in got) and len(got) == len(sizes)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a>Menu</a></li><li><a>More</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- c -->
<article><h1>Title &amp; more</h1><p>First   <b>bold</b>\n text<br>next<p>Unclosed &copy; &#233; %s<ul><li>Item<li>Two</ul><aside>side</aside><form><p>Your mail</p></form><div class="comments"><p>Nice!</p></div></article>
<div class="sidebar"><p>Related</p></div><footer><p>(c)</p></footer></body></html>"""
WANT = "Title & more\n\nFirst bold text next\n\nUnclosed © é %s\n\nItem\n\nTwo"


def test_html(spark):
    plain = "<body><div><p>menu</p></div><div class=content><p>Long story %s, with much text in it.</p><p>Second part %s.</p></div><footer>f</footer>"
    rows = [(i, f"http://a.example/{i}", PAGE % i, 1) for i in range(12)] + [(100 + i, f"https://b.example/{i}?q", plain % (i, i), 1) for i in range(6)]
    rows += [(200, None, PAGE % "x", 1), (201, "nonsense", None, 1), (202, "http://a.example/e", "", 1), (203, "http://a.example/t", "no tags at all", 1), (None, "http://a.example/0", PAGE % 0, 1), (204, "http://a.example/cut", "<article><p>cut <b", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in html_extract.extract_pages(df).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    for i in range(12):
        assert got[i].text == WANT % i
    assert got[103].text == "Long story 3, with much text in it.\n\nSecond part 3."
    assert got[200].text == WANT % "x" and got[201].text == "" and got[202].text == "" and got[203].text == "no tags at all" and got[204].text == "cut"
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_wrapper_groups_and_options():
    pages = [f"<body><ul>{'<li>x</li>' * k}</ul><p>text {k}</p>{'<i>extra</i>' if k % 2 else ''}</body>" for k in (2, 5, 3)]
    wrapper = None
    for p in pages:
        wrapper = html_extract.align(wrapper, html_extract.describe(p))
    keys = [i[0] for i in wrapper]
    assert any(isinstance(k, tuple) and k[1][0] == "<li." for k in keys)
    assert next(i for i in wrapper if i[0] == "<i.")[1] is True and next(i for i in wrapper if i[0] == "<p.")[1] is False
    assert html_extract.load(html_extract.dump(wrapper)) == wrapper


def test_sharding_clashes(docs):
    assert sharding.shard(docs).count() == len(ROWS)


def test_line_dedup_by_join_and_by_workers(spark, docs, monkeypatch):
    rows = [(i if i % 5 else None, f"own {i}\r\n  shared footer \n\n{'long ' * 3000}\nlocal {i % 3}", f"site{i % 9}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(docs.select("doc_id", "text", "source")).withColumn("pos", F.lit(1))
    near = [tuple(r) for r in line_dedup.drop_lines(df).collect()]
    monkeypatch.setattr(line_dedup, "BAD_LINES", 0)
    same([tuple(r) for r in line_dedup.drop_lines(df).collect()], near)
    sites = defaultdict(set)
    plain = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    for _, t, s in plain:
        for x in (t or "").split("\n"):
            sites[x.strip(" \t\n\x0b\x0c\r")].add(s)
    gone = {x for x, on in sites.items() if x and len(on) >= line_dedup.SITES}
    want = []
    for i, t, _ in plain:
        lines = [(x, x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
        want.append((i, "\n".join(x for x, y in lines if y not in gone), sum(y != "" for _, y in lines), sum(y in gone for _, y in lines)))
    assert any("shared" in x for x in gone)
    same(near, want)


def test_line_dedup_tells_lines_of_one_hash_apart(spark, monkeypatch):
    # All lines of a length share a key here.
    monkeypatch.setattr(line_dedup, "_key", lambda line: F.when(line.rlike(r"\S"), F.char_length(F.trim(line)).cast("long")))
    rows = [(i, f"everywhere\nonly here{i % 2}", f"site{i}") for i in range(12)]
    got = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites=8).collect()
    assert all(r.text == f"only here{r.doc_id % 2}" and r.n_removed == 1 for r in got)


def test_language_sample_is_bounded(spark):
    rows = [(i, f"text number {i} " * (1 + i % 7), f"l{i % 3}" if i % 50 else "rare") for i in range(2000)] + [(5000, "alone here", "single"), (5001, None, "l0"), (5002, "no language", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df = df.unionByName(df)
    held = {i for i, _, _ in rows if __import__("zlib").crc32(str(i).encode()) % 5 == 0}
    texts = {t: x for i, t, x in rows if i not in held and t and x}
    for cap, size in ((100, 1 << 20), (100, 900), (7, 1 << 20)):
        got = [tuple(r) for r in language_id.draw(df, rows=cap, size=size).collect()]
        assert 0 < len(got) <= cap and sum(len(t) for t, _ in got) <= size and all(texts[t] == x for t, x in got)
        same(got, [tuple(r) for r in language_id.draw(df.repartition(9), rows=cap, size=size).collect()])
    full = Counter(x for _, x in (tuple(r) for r in language_id.draw(df, rows=100).collect()))
    per = 100 // len(set(texts.values()))
    have = Counter(x for i, t, x in rows if i not in held and t and x)
    assert full == {x: min(per, n) for x, n in have.items()}
    # More languages than a fixed list would hold; each is learned while rows last.
    many = [(i, f"word{i} words", f"x{i % 700:03}") for i in range(3000)]
    learned = {x for i, _, x in many if __import__("zlib").crc32(str(i).encode()) % 5}
    drawn = language_id.draw(spark.createDataFrame(many, "doc_id long, text string, lang string"), rows=1400)
    assert len(learned) > 690 and {r.lang for r in drawn.collect()} == learned


def test_language_scores_against_plain_loops(spark):
    """Subwords, average, layer and temperature written out one by one."""
    import math

    from sparkloom.llm.shingles import stream

    mask = (1 << 64) - 1
    mix = [int(x) | 1 for x in stream(4, 77)]

    def scramble(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def plain(text):
        out = []
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            w = [0, *map(ord, word), 0]
            for n in (2, 3, 4):
                for i in range(len(w) - n + 1):
                    out.append(scramble((n + sum(c * mix[k] for k, c in enumerate(w[i : i + n]))) & mask) >> 48)
        return out

    rows = [(i, f"the {i} of and that" if i % 2 else f"der die {i} das und", "en" if i % 2 else "de") for i in range(200)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["the thing", "Das Haus!", "a", "x9y Über—den", " und\tund ", "ο λόγος 日本", "the " * 500]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        grams = plain(text)
        assert sorted(grams) == sorted(language_id.subwords(text).tolist())
        mean = [sum(float(model.table[g][d]) for g in grams) / len(grams) for d in range(model.table.shape[1])]
        z = [(sum(m * float(w) for m, w in zip(mean, model.weights[:, k], strict=True)) + float(model.bias[k])) / model.temperature for k in range(len(model.languages))]
        p = [math.exp(x) / sum(map(math.exp, z)) for x in z]
        assert model.languages[p.index(max(p))] == got[i].lang_pred and abs(max(p) - got[i].score) < 1e-4, text


def test_language_ties_take_the_first(spark):
    import numpy as np

    even = language_id.Model(["aa", "bb"], np.zeros((language_id.BUCKETS, language_id.DIM), np.float32), np.zeros((language_id.DIM, 2), np.float32), np.zeros(2, np.float32))
    r = language_id.identify(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), even).first()
    assert (r.lang_pred, r.score) == ("aa", 0.5)


def test_mix_of_rows_without_identifiers(spark):
    rows = [(None, f"text {i} " * (1 + i % 9), "a" if i % 4 else "b") for i in range(300)] + [(None, "same row", "a")] * 50 + [(7, f"shares seven {i % 5}", "b") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tags", F.create_map(F.lit("k"), F.lit(1)))
    plan = mixing.plan_mix(df).collect()
    mixed = [tuple(r)[:3] for r in mixing.mix(df).collect()]
    assert len(mixed) == sum(r.copies for r in plan) and set(mixed) <= set(rows)
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"}
    taken = Counter()
    for _, t, s in mixed:
        taken[s] += len(t.split())
    assert all(abs(taken[s] - r.target) <= 40 for s in "ab" for r in plan if r.source_size == size[s])
    assert all(n <= 3 * rows.count(r) for r, n in Counter(mixed).items())
    same(mixed, [tuple(r)[:3] for r in mixing.mix(df.repartition(3)).collect()])
