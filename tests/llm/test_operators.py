"""Each operator against a plain version on small awkward tables, the libraries it must agree with, or held-out rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetwear.llm import katz, posting_lists, quality_model
from fleetwear.llm.bpe import Codec, encode_run, encode_texts, ready
from fleetwear.llm.catalog import tokenizer_path
from fleetwear.llm.components import components
from fleetwear.llm.jaccard_join import near_duplicates
from fleetwear.llm.kd_shards import shard_documents
from fleetwear.llm.packing import OpenBins, RankCodec, pack_documents
from fleetwear.llm.quality_rules import judge
from fleetwear.llm.repeats import remove_repeats
from fleetwear.llm.url_rules import filter_urls

SF = "/root/testdata/sf0.001"
WORD_BPE, BYTE_BPE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return plain.documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return plain.documents(spark, none=True)


def ordered(values):
    return sorted(values, key=repr)


# 1. quality rules


def test_rules_count_like_the_plain_version(docs):
    got = judge(docs).collect()
    want = [(r[0], *plain.base_counts(r[1])) for r in plain.rows()]
    assert ordered((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == ordered(want)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)


def test_rules_reject_what_is_unlike_its_language(spark):
    rng = random.Random(1)
    usual = ["the house of the old man is in the wood and by the lake it was quiet".split()[rng.randrange(16)] for _ in range(4000)]
    normal = [(k, " ".join(usual[100 * k : 100 * k + 100]), "en") for k in range(30)]
    odd = [(100, " ".join(f"{w.upper()}###{k}$$$" for k, w in enumerate(usual[:100])), "en")]
    lone = [(101, " ".join(f"{w}{k}" for k, w in enumerate(usual[:100])), None)]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(normal + odd + lone, "doc_id long, text string, lang string"), max_repeat_percent=100).collect()}
    assert all(got[k].kept for k in range(30)) and not got[100].kept and got[101].kept
    assert 0 <= got[0].char_distance < got[100].char_distance <= 1


def test_rules_reject_a_long_text_without_common_words(spark):
    rng = random.Random(2)
    usual = "the house of the old man is in the wood and by the lake it was quiet".split()
    texts = [" ".join(rng.choices(usual, k=300)) for _ in range(30)]
    strange = " ".join("".join(rng.choices("aehilnostu", k=4)) for _ in range(300))
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(100, strange, "en")]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_repeat_percent=100).collect()}
    assert all(got[k].kept for k in range(30))
    assert not got[100].base_failed and got[100].char_distance < 0.3 and got[100].word_distance > 0.28 and not got[100].kept


def test_rules_of_nothing(none):
    assert judge(none).count() == 0


# 2. n-gram Jaccard join


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_join_finds_every_component(docs, size, percent):
    rows = plain.rows()
    sets = [plain.shingles(r[1], size) for r in rows]
    of = plain.reachable(sets, percent)
    least: dict[int, int] = {}
    for r, c in zip(rows, of, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = [(r[0], len(s), least.get(c) if s else r[0]) for r, s, c in zip(rows, sets, of, strict=True)]
    got = near_duplicates(docs, size, percent).collect()
    assert ordered((r.doc_id, r.n_shingles, r.component_id) for r in got) == ordered(want)


def test_join_of_a_large_near_group_and_of_nothing(spark, none):
    rng = random.Random(3)
    base = [f"b{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for k in range(300):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    of = plain.reachable([plain.shingles(t, 3) for _, t in rows], 90)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == dict(enumerate(of))
    assert near_duplicates(none).count() == 0


def test_components_of_a_long_path(spark):
    rng = random.Random(2)
    names = rng.sample(range(10**6), 300)
    links = [(a, b) for a, b in zip(names, names[1:], strict=False)] + [(5, 5), (None, 3), (-1, -2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {n: min(names) for n in names} | {-1: -2, -2: -2}


# 3. sharding


def test_shards_are_even_and_whole(spark, docs, none):
    rows = [(k, "x" * random.Random(k).randrange(400) if k % 3 else "copy of one text " * 4, f"l{k % 5}", f"s{k % 7}") for k in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = shard_documents(table, shards=7, slot_rows=100).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 7 and by.max() < 1.02 * by.mean()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    small = shard_documents(docs, shards=5).collect()
    assert ordered((r.doc_id, r.size, r.text_crc32) for r in small) == ordered(
        (r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in plain.rows()
    )
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 5 for r in small)
    assert shard_documents(none).count() == 0
    assert shard_documents(table, shards=None, target_bytes=100_000).select("shard").distinct().count() >= 4


def test_equal_texts_share_a_shard(spark):
    rows = [(k, f"text number {k // 3} " * 5, "en", f"s{k % 4}") for k in range(900)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=6).collect()
    shard = {r.doc_id: r.shard for r in got}
    assert all(shard[k] == shard[k - k % 3] for k in range(900))


# 4. byte-pair encoding


@pytest.fixture(scope="module", params=[WORD_BPE, BYTE_BPE])
def codec(request):
    return (*ready(request.param), Tokenizer.from_file(request.param))


ODD = st.text(alphabet=st.one_of(st.sampled_from("abstdrevml'AS 1.,\n\té́ßσΣİ🙂<|>"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])), max_size=30)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(ODD, st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "</w>", "the", " ", "ing", "’s", "'s"]), max_size=8).map("".join)))
def test_ids_and_texts_agree_with_the_library(codec, text):
    ours, store, theirs = codec
    data = np.frombuffer(text.encode(), np.uint8)
    ids, cut = encode_run(ours, store, data, np.array([0, len(data)]))
    want = theirs.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want and cut.tolist() == [0, len(want)]
    assert ours.decode(ids).decode() == theirs.decode(want, skip_special_tokens=False)


def test_every_token_is_compatible_with_itself_only_as_the_merges_say():
    ours, theirs = Codec(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    words = ["aaaaaaaaaa", "hahahahaha", "nonononononon", "zzzzzzzzzzz", "xqxqxqxq" * 20]
    assert [ours.encode_words([w.encode()])[0] for w in words] == [theirs.encode(w, add_special_tokens=False).ids for w in words]


def test_encoding_a_table(docs, none):
    theirs = Tokenizer.from_file(WORD_BPE)
    want = []
    for r in plain.rows():
        ids = theirs.encode(r[1] or "", add_special_tokens=False).ids
        text = theirs.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = encode_texts(docs, WORD_BPE, digest=True)
    assert ordered(tuple(r) for r in got.collect()) == ordered(want)
    assert encode_texts(docs, WORD_BPE).filter("n_tokens != size(ids)").count() == 0
    assert encode_texts(none, WORD_BPE).count() == 0


# 5. nearest neighbours


def test_neighbours_reach_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.4 * rng.normal(size=(4000, 16))
    x[100] = x[50]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] + [1.0] * 15), (5150, [None] + [1.0] * 15), (5200, [1.0]), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = posting_lists.nearest(table, list_rows=100, part_rows=50).toPandas()
    assert sorted(set(got["query_id"])) == list(range(0, 4000, 50))
    hit = 0
    for q, part in got.groupby("query_id"):
        scores = posting_lists.cosine(x[q], x)
        scores[q] = -9
        best = np.lexsort((np.arange(4000), -scores))[:5]
        part = part.sort_values("rank")
        assert list(part["rank"]) == [1, 2, 3, 4, 5]
        assert all(abs(scores[v] - s) < 1e-12 for v, s in zip(part["vec_id"], part["score"], strict=True))
        assert list(zip(-part["score"], part["vec_id"], strict=True)) == sorted(zip(-part["score"], part["vec_id"], strict=True))
        hit += len(set(best) & set(part["vec_id"]))
    assert hit >= 0.95 * 5 * got["query_id"].nunique()
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert posting_lists.nearest(few).count() == 2
    assert posting_lists.nearest(few.limit(0)).count() == 0


def test_neighbours_without_clusters_are_not_cut_at_the_beam(spark):
    x = np.random.default_rng(5).normal(size=(1500, 32))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = posting_lists.nearest(table, list_rows=10, beam=8, visit=2.0).toPandas()  # the ratio selects every list
    assert got["query_id"].nunique() == 30
    for q, part in got.groupby("query_id"):
        scores = posting_lists.cosine(x[q], x)
        scores[q] = -9
        assert list(part.sort_values("rank")["vec_id"]) == list(np.lexsort((np.arange(1500), -scores))[:5])


def test_neighbours_of_short_lists_are_as_many_as_asked(spark):
    x = np.repeat(np.eye(32), 2, axis=0)  # a list holds two vectors; no other lies within the ratio
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = posting_lists.nearest(table, every=1, list_rows=2).toPandas()
    assert got["query_id"].nunique() == 64 and all(sorted(r) == [1, 2, 3, 4, 5] for _, r in got.groupby("query_id")["rank"])
    assert (got.loc[got["rank"] == 1].set_index("query_id")["vec_id"] == [k ^ 1 for k in range(64)]).all()


def test_centroids_are_balanced():
    x = np.random.default_rng(0).normal(size=(1000, 8))
    c = posting_lists.balanced_centroids(x / np.linalg.norm(x, axis=1)[:, None], 16)
    order, distance = posting_lists.CentroidGraph(c).search(c, 16)
    assert c.shape == (16, 8) and (order[:, 0] == np.arange(16)).all() and np.allclose(distance[:, 0], 0, atol=1e-3)


# 6. quality classifier


def test_classifier_on_held_out_rows(spark):
    folder = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality_model.train(docs, labels, max_rows=2000)
    got = quality_model.classify(docs, model).join(labels, "doc_id").filter("held_out").toPandas()
    assert all(zlib.crc32(str(k).encode()) % 5 == 0 for k in got["doc_id"])
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (got["predicted"] == (got["score"] >= 0.3)).all() and (good >= 0.3).mean() > 0.98


def test_classifier_on_awkward_rows(docs, none):
    x, y = np.random.default_rng(1).normal(size=(400, len(quality_model.FEATURES))), np.zeros(400)
    y[(x[:, 0] > 0) ^ (x[:, 1] > 0)] = 1  # only a pair of features tells
    model = quality_model.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.85
    got = quality_model.classify(docs, model).collect()
    assert ordered(r.doc_id for r in got) == ordered(r[0] for r in plain.rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality_model.classify(none, model).count() == 0
    empty = quality_model.train(none, none.selectExpr("doc_id", "1 AS quality"))
    assert quality_model.classify(docs, empty).select("score").distinct().count() == 1
    assert quality_model.keep_good(docs, empty).columns == docs.columns


# 7. packing


def test_packing_a_table(docs, none):
    theirs = Tokenizer.from_file(BYTE_BPE)
    width = 64
    got = pack_documents(docs, BYTE_BPE, width=width, keep_ids=True).toPandas()
    want = Counter()
    for r in plain.rows():
        ids = [*theirs.encode(r[1] or "", add_special_tokens=False).ids, 2]
        head = len(ids) % width or width
        for k, a in enumerate([0, *range(head, len(ids), width)]):
            piece = ids[a : head if k == 0 else a + width]
            want[(-1 if r[0] is None else r[0], k, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), tuple(piece))] += 1
    ours = Counter((-1 if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got.itertuples())
    assert ours == want
    for _, part in got.groupby("sequence_id"):
        at = 0
        for r in part.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= width
    assert pack_documents(none, BYTE_BPE).count() == 0


@settings(max_examples=50, deadline=None)
@given(sizes=st.lists(st.integers(1, 40), max_size=200), places=st.integers(1, 8))
def test_bins_take_the_fullest_that_fits(sizes, places):
    bins, free, closed = OpenBins(40, places), {}, 0
    for n in sizes:
        one, at = bins.place(n)
        fits = [f for f in free.values() if f >= n]
        if fits:
            assert free[one] == min(fits) and at == 40 - free[one]
        else:
            assert one not in free and at == 0
        left = free.pop(one, 40) - n
        if left:
            if not fits and len(free) == places:
                gone = min(free.values())
                free.pop(next(k for k, f in sorted(free.items(), reverse=True) if f == gone and k not in {b for bs in bins.by_free for b in bs}))
                closed += 1
            free[one] = left
        assert len(free) <= places


def test_ranks_reach_every_token():
    theirs, ours = Tokenizer.from_file(BYTE_BPE), RankCodec(BYTE_BPE)
    vocab = [i for t, i in theirs.get_vocab().items() if t not in ours.special]
    texts = [theirs.decode([i]).encode() for i in vocab]
    whole = [(i, t) for i, t in zip(vocab, texts, strict=True) if "�" not in t.decode("utf-8", "replace")]
    assert ours.encode_words([t for _, t in whole]) == [[i] for i, _ in whole]


# 8. repeated passages


@pytest.mark.parametrize(("window", "block_bytes"), [(35, 1 << 20), (35, 500), (9, 2000)])
def test_repeats_go_and_nothing_else(docs, window, block_bytes):
    rows = plain.rows()
    want = []
    for r, (w, gone) in zip(rows, plain.without_repeats([r[1] for r in rows], window), strict=True):
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = remove_repeats(docs.select("doc_id", "text"), window, digest=True, block_bytes=block_bytes)
    assert ordered(tuple(r) for r in got.collect()) == ordered(want)


def test_repeats_keep_other_columns(docs, none):
    got = remove_repeats(docs.withColumnRenamed("score", "n_words"))
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "key", "block", "n_words", "n_removed", "text"]
    untouched = {r.doc_id: r.text for r in got.filter("n_removed = 0").collect()}
    assert all(t == (dict((r[0], r[1]) for r in plain.rows())[k] or "") for k, t in untouched.items() if k != 9)
    assert remove_repeats(none).count() == 0


# 9. Katz backoff


def test_scores_are_those_of_the_plain_model(docs, none):
    rows = plain.rows()
    tokens = [[*plain.WORD.findall(plain.lower(r[1] or "")), "</s>"] for r in rows]
    out = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    single, pairs = Counter(), Counter()
    for w, o in zip(tokens, out, strict=True):
        if not o:
            single.update(w)
            pairs.update(zip(["<s>", *w], w, strict=False))
    n, v = sum(single.values()), len(single)
    times = lambda c: [sum(x == r for x in c.values()) for r in range(1, 7)]
    one, two = katz.discounts(times(single)), katz.discounts(times(pairs))
    cut = lambda d, c: c * (d[c] if c <= 5 else 1.0)
    kept = sum(cut(one, c) for c in single.values())
    total = n if kept < n else n + 1
    alone = lambda w: cut(one, single[w]) / total if single[w] else 1 - kept / total
    info = {}
    for h, f in plain.followers(pairs).items():
        c, k = sum(f.values()), sum(cut(two, x) for x in f.values())
        divisor = c if k < c else c + 1
        info[h] = (f, divisor, (1 - k / divisor) / (1 - sum(map(alone, f))))

    def probability(w, h):
        if h not in info:
            return alone(w)
        f, divisor, weight = info[h]
        return cut(two, f[w]) / divisor if w in f else weight * alone(w)

    for h in [*list(info)[:5], "never seen"]:
        assert math.isclose(sum(probability(w, h) for w in [*single, "an unknown word"]), 1, rel_tol=1e-9)
    want = []
    for r, w, o in zip(rows, tokens, out, strict=True):
        base = sum(math.log10((single[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(probability(b, a)) for a, b in zip(["<s>", *w], w, strict=False))
        want.append((r[0], o, len(w), sum(single[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    for sizes in ((1 << 20, 1 << 20), (700, 900)):
        got = katz.score_texts(docs, block_bytes=sizes[0], part_bytes=sizes[1]).collect()
        assert ordered((*r[:5], round(r.base_score, 6), round(r.score, 6)) for r in got) == ordered(want)
    assert katz.score_texts(none).count() == 0


# 10. URLs


def test_urls_by_listed_and_mined_rules(spark):
    urls = [
        ("http://A.Net/x", "a.net", "/x", "net/", "block"),
        ("http://example.net/en/1", "example.net", "/en/1", "example.net/en/", "allow"),
        ("http://sub.example.net/de/1", "sub.example.net", "/de/1", "net/", "block"),
        ("https://www.EXAMPLE.com/de/?q=1", "www.example.com", "/de/", "example.com/de/", "block"),
        ("http://x.org/fr/#a", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://x.org?u=http://y.net/z", "x.org", "", None, "allow"),
        ("no scheme.net/x", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("://net", "net", "", None, "allow"),
    ]
    rows = [(k, u[0], "h") for k, u in enumerate(urls)]
    for k in range(400):
        bad = k % 4 == 0
        rows.append((1000 + k, f"https://{'casino-win' if bad else 'news'}{k % 9}.com/{'play' if bad else 'read'}/{k}?ref=x", None))
    labels = [(1000 + k, 0 if k % 4 == 0 else 1, 0) for k in range(0, 300)] + [(None, 0, 0), (3, None, None)]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, host string").repartition(2)
    got = filter_urls(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) + 1
    assert [(by[k].host, by[k].path, by[k].rule, by[k].verdict) for k in range(len(urls))] == [u[1:] for u in urls]
    assert all(by[1000 + k].verdict == ("block" if k % 4 == 0 else "allow") for k in range(400))
    assert by[1396].mined is not None and by[1396].rule is None
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.verdict for r in filter_urls(pages.filter("page_id >= 1000"), nothing).collect()} == {"allow"}
    assert filter_urls(pages.limit(0), nothing).count() == 0
