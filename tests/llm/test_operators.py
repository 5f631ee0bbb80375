"""The training-data operators against brute force, round trips and odd inputs."""

import collections
import hashlib
import math
import random
import zlib
from array import array

import duckdb
import numpy as np
import pytest

from runfold.llm import audio, common, minhash, mixing, packing, perplexity, quality_cnn, queries, sample, sharding, toxicity, url_filter, warc
from runfold.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join(r.choice("alpha beta gamma delta rivers of stone and light under the old harbour where nobody waits for morning".split()) + r.choice(["", "", ",", "."]) + str(r.randint(0, 99)) * (r.random() < 0.3) for _ in range(n))


def corpus(seed=1, n=60):
    """Rows with nulls in every column, empty and long texts, copies, ties and repeated rows."""
    r = random.Random(seed)
    rows = [(i, prose(r, r.randint(1, 300)), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "d"]), 1) for i in range(n)]
    rows += [(1000 + i, rows[3][1], "en", "a", None) for i in range(8)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "a", 0), (2002, " \n\t ", "en", "b", 3), (None, "no id here", "en", None, 1), (2003, prose(r, 6000), "en", "c", 1), (2004, "x", "en", "e", 1)]
    return [*rows, rows[5], rows[5]]


def frame(spark, rows, schema=DOCS, clash=True):
    df = spark.createDataFrame(rows, schema).repartition(3)
    if clash:
        for c in ("__part", "score", "size", "bucket", "digest", "target", "length", "sequence_id", "rule", "kept"):
            df = df.withColumn(c, df[df.columns[0]].cast("string"))
    return df


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# packing


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(tokenizer_path()), packing.WordEncoder(tokenizer_path())
    texts = ["", " ", "It's the dog's, I'LL say; ÀÉ Straße x²½ ×÷", "İ ΣΑΣ ﬁ é ̈ 日本 12345 a\xa0b\x85c\x1cd", "<|endoftext|> <|startoftext|>x", "a" * 3000, *(t for _, t, *_ in corpus() if t)]
    for t in texts:
        assert words.encode(t) == array("I", whole.encode(t, add_special_tokens=False).ids).tobytes(), t


def test_other_tokenizers_are_not_split(tmp_path):
    """A tokenizer file with other rules, here one that keeps capitals, gives its own ids."""
    import json

    from tokenizers import Tokenizer

    with open(tokenizer_path()) as f:
        file = json.load(f)
    file["normalizer"]["normalizers"].pop()
    path = f"{tmp_path}/other.json"
    with open(path, "w") as f:
        json.dump(file, f)
    whole, other, own = Tokenizer.from_file(path), packing.WordEncoder(path), packing.WordEncoder(tokenizer_path())
    assert own.by_word and not other.by_word
    for t in ("Some CAPITALS here", "x  y", ""):
        assert other.encode(t) == array("I", whole.encode(t, add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("seed", range(4))
def test_sums_find_what_a_search_finds(seed):
    import itertools

    r = random.Random(seed)
    left = np.zeros(31, np.int64)
    for _ in range(14):
        left[r.randint(1, 30)] += r.randint(1, 2)
    sums = packing.Sums(left)
    for _ in range(60):
        length = r.choice(np.flatnonzero(left).tolist() or [1])
        if not left[length]:
            break
        for parts in (1, 2, 3):
            found = sums.complement(length, 30 - length, parts)
            pool = [k for k in range(1, 31) for _ in range(int(left[k]) - (k == length))]
            assert (found is not None) == any(sum(c) == 30 - length for c in itertools.combinations(pool, parts))
            if found:
                assert sum(found) == 30 - length and all(left[k] >= n for k, n in collections.Counter((length, *found)).items())
        left[length] -= 1


def test_pack(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    docs, cap = corpus(), 256
    got = rows_of(packing.pack_documents(frame(spark, docs), tokenizer_path(), cap))
    want = collections.Counter()
    for doc_id, text, *_ in docs:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), cap)):
            part = ids[at : at + cap]
            want[(doc_id, p, at, len(part), zlib.crc32(array("I", part).tobytes()))] += 1
    assert collections.Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == want
    by = collections.defaultdict(list)
    for g in got:
        by[g["sequence_id"]].append((g["offset"], g["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= cap
    assert len(by) <= 1.01 * plain_best_fit([g["length"] for g in got], cap)
    assert packing.pack_documents(frame(spark, []), tokenizer_path(), cap).count() == 0


def plain_best_fit(lengths, cap):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= n]
        if fit:
            gaps[min(fit, key=gaps.__getitem__)] -= n
        else:
            gaps.append(cap - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_solve(seed):
    r = random.Random(seed)
    cap = r.choice([7, 40, 200])
    counts = {r.randint(1, cap): r.randint(1, 30) for _ in range(r.randint(1, 40))}
    patterns = packing.solve(counts, cap)
    used = collections.Counter()
    for p in patterns:
        assert sum(length * n for length, n in p.items) <= cap
        for length, n in p.items:
            used[length] += n * p.repeats
    assert used == collections.Counter(counts)
    table = packing.slots(patterns)
    assert (np.diff(table[:, 0]) >= 0).all()


def test_exact_complements_are_found():
    patterns = packing.solve({6: 2, 4: 1, 3: 1, 1: 1, 5: 1, 2: 2}, 10)
    assert sum(p.repeats for p in patterns) == 3


# sharding


def test_shards(spark):
    docs = corpus()
    got = rows_of(sharding.shard_documents(frame(spark, docs), 5))
    assert len(got) == len(docs)
    groups = collections.Counter()
    for _, text, *_ in docs:
        groups[hashlib.md5((text or "").encode()).hexdigest()] += len((text or "").encode()) + 8
    ordered = [groups[k] for k in sorted(groups)]
    best = min_capacity(ordered, 5)
    load, slots, of = collections.Counter(), collections.defaultdict(list), {}
    for g in got:
        load[g["shard"]] += g["size"]
        slots[g["shard"]].append(g["slot"])
        assert of.setdefault(g["text_crc32"], g["shard"]) == g["shard"]
    assert max(load.values()) == best
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {g["law"] for g in got} == {"bytes"} and {g["grown_shard"] for g in got} == {None}
    assert sharding.shard_documents(frame(spark, []), 5).count() == 0


def min_capacity(sizes, shards):
    """By dynamic programming over all contiguous partitions."""
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    best = total[:]
    for _ in range(shards - 1):
        best = [0, *(min(max(best[j], total[i] - total[j]) for j in range(i)) for i in range(1, len(total)))]
    return best[-1]


@pytest.mark.parametrize("seed", range(8))
def test_refined_search_is_exact(seed):
    r = random.Random(seed)
    groups = sorted((hashlib.md5(f"{seed}-{i}".encode()).hexdigest(), int(100 * r.paretovariate(1.2))) for i in range(r.choice([1, 7, 90])))

    def sums(keep, digits):
        out = {}
        for k, v in groups:
            if keep is None or any(k.startswith(p) for p in keep):
                size, n = out.get(k[:digits], (0, 0))
                out[k[:digits]] = (size + v, n + 1)
        return [sharding.Block(k, *v) for k, v in sorted(out.items())]

    blocks = sums(None, 1)
    while split := sharding.refine(blocks, 4):
        finer = sums(split, len(next(iter(split))) + 2)
        blocks = sorted([b for b in blocks if b.prefix not in split] + finer, key=lambda b: b.prefix)
    assert sharding.smallest_capacity([b.size for b in blocks], 4) == min_capacity([v for _, v in groups], 4)


def test_hot_group_leaves_other_shards_even(spark):
    """A text with a third of the bytes has a shard; the others share the rest nearly evenly."""
    r = random.Random(2)
    docs = [(i, f"{i} " + "x" * r.randint(80, 120), "en", "a", 1) for i in range(600)]
    docs += [(1000 + i, "hot " + "y" * 96, "en", "a", 1) for i in range(300)]
    got = rows_of(sharding.shard_documents(frame(spark, docs), 12))
    load, hot = collections.Counter(), set()
    for g in got:
        load[g["shard"]] += g["size"]
        hot |= {g["shard"]} if g["doc_id"] >= 1000 else set()
    assert set(load) == set(range(12)) and len(hot) == 1
    others = [n for k, n in load.items() if k not in hot]
    assert load[hot.pop()] == 300 * 108 and max(others) < 1.25 * min(others)


# url filter


PAGES = [
    (1, "http://A.example.org/es/1?x#y", '<a href="http://bad.test.net/x">'),
    (2, "https://a.example.org/en/12", None),
    (3, "https://www.shop.com/fr/1", "<a href='//friend.net/a'> <A HREF=https://Friend.NET:80/b>"),
    (4, "https://www.shop.com/de/1", ""),
    (5, "http://friend.net/", "x"),
    (6, "http://bad.test.net/q", '<a href="https://evil.com/de/1">' * 3),
    (7, "http://evil.com/de/4", ""),
    (8, "http://evil.com", "none"),
    (9, None, None),
    (10, "no scheme", "<p>"),
    (11, "ftp://lonely.xyz?q", ""),
    (None, "http://friend.net/z", ""),
    (5, "http://friend.net/", "x"),
    (12, "http://org/", ""),
    (13, "http://u:p@evil.com:8080/x", "<a href='http://me@target.biz:81/'>"),
    (14, "http://target.biz/", None),
]


def test_page_rank_equals_many_plain_rounds(spark):
    """A long chain with dead ends and two parts: the same scores as 400 rounds of the rule, dead ends giving back to the seeds."""
    edges = [(f"h{i}", f"h{i + 1}", 1 + i % 3) for i in range(40)] + [("h3", "x", 2), ("y", "h0", 1), ("h9", "h2", 5)]
    seeds = [("trust", "h0", 3.0), ("trust", "y", 1.0), ("distrust", "h40", 2.0)]
    got = {(r.kind, r.host): r.score for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "kind string, host string, score double")).collect()}
    for kind in ("trust", "distrust"):
        out = collections.defaultdict(list)
        for a, b, n in edges:
            out[a if kind == "trust" else b].append((b if kind == "trust" else a, n))
        base = {h: s / sum(x for k, _, x in seeds if k == kind) for k, h, s in seeds if k == kind}
        rank = dict(base)
        for _ in range(400):
            after = collections.defaultdict(float)
            lost = sum(s for h, s in rank.items() if not out[h])
            for h, s in base.items():
                after[h] += (0.15 + 0.85 * lost) * s
            for h, s in rank.items():
                for to, n in out[h]:
                    after[to] += 0.85 * s * n / sum(m for _, m in out[h])
            rank = after
        assert {h for k, h in got if k == kind} >= {h for h, s in rank.items() if s > 1e-12}
        assert all(abs(got.get((kind, h), 0) - s) < 1e-6 for h, s in rank.items())


def test_rounds_of_few_hosts_take_few_tasks(spark, monkeypatch):
    """Each task of a round writes shuffle files of its own, so many partitions of few rows fill the disk."""
    sizes = []
    drop = common.drop
    monkeypatch.setattr(common, "drop", lambda *written: (sizes.extend(len(w.inputFiles()) for w in written), drop(*written)))
    edges = spark.createDataFrame([(f"h{i}", f"h{i * 7 % 50}", 1) for i in range(50)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", f"h{i}", 1.0) for i in range(10)] + [("distrust", "h3", 1.0)], "kind string, host string, score double")
    monkeypatch.setattr(url_filter, "STEPS", 2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        url_filter.propagate(edges, seeds, tolerance=0.05).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sizes and max(sizes) == 1


def test_url_filter(spark):
    pages = frame(spark, PAGES, "page_id long, url string, html string")
    got = url_filter.filter_urls(pages).toPandas()
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url", "html").toPandas())
    want = con.execute(url_filter.oracle()).df()
    key = lambda t: sorted(map(str, t[sorted(t.columns)].astype(object).where(t[sorted(t.columns)].notna(), None).itertuples(index=False)))
    assert [x.replace(".0", "") for x in key(got)] == [x.replace(".0", "") for x in key(want)]
    by = {r["page_id"]: r for r in got.to_dict("records")}
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert by[2]["rule"] == "example.org/en/1" and by[12]["rule"] == "org/"
    assert by[8]["verdict"] == "block" and by[8]["rule"] is None  # a blocked host's other page
    assert by[6]["verdict"] == "block"  # links to blocked pages
    assert by[5]["verdict"] == "allow" and by[9]["verdict"] == "allow" and by[9]["host"] == ""
    assert by[13]["verdict"] == "block" and by[13]["host"] == "u:p@evil.com:8080"  # the same host in the graph
    assert url_filter.filter_urls(frame(spark, [], "page_id long, url string, html string")).count() == 0


# perplexity


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts():
    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choice(["a", "b ", "é", "\n", "\t", "# ", "日", "\x85", "aa bb cc ", "\x1c"]) for _ in range(r.randint(0, 60)))
        assert perplexity.base_counts(text) == brute_counts(text)


def test_kneser_ney_by_hand():
    """Each probability as the formula has it, over dictionaries."""
    r = random.Random(4)
    text = "".join(r.choice("abcd e") for _ in range(400))
    keys = perplexity.trigrams(text)
    tri = collections.Counter(keys.tolist())
    model = perplexity.fit(np.array(sorted(tri)), np.array([tri[k] for k in sorted(tri)]))
    C = perplexity.CLASSES
    bi = collections.Counter(k % C**2 for k in tri)
    uni = collections.Counter(k % C for k in bi)
    d = {n: perplexity.discounts(np.array(list(c.values()))) for n, c in ((3, tri), (2, bi), (1, uni))}

    def prob(n, key):
        if n == 0:
            return 1 / C
        counts = {3: tri, 2: bi, 1: uni}[n]
        same = {k: v for k, v in counts.items() if n == 1 or k // C == key // C}
        shorter = prob(n - 1, key % C ** (n - 1) if n > 1 else 0)
        if not same:
            return shorter
        left = sum(d[n][min(v, 3)] for v in same.values())
        c = counts.get(key, 0)
        return (c - (d[n][min(c, 3)] if c else 0) + left * shorter) / sum(same.values())

    probe = np.array([*sorted(tri)[:50], *range(9 * C * C, 9 * C * C + 40), 63 * C * C + 63 * C + 63])
    assert np.allclose(np.exp(model.logp(probe)), [prob(3, int(k)) for k in probe], rtol=1e-4)


def word_model():
    r = random.Random(6)
    names = ["the", "cat", "a", "dog", "Sat", "über", "ran", "x1"]
    texts = [" ".join(r.choices(names, [40, 5, 5, 5, 3, 2, 2, 1], k=r.randint(1, 40))) for _ in range(60)]
    tri = collections.Counter(k for t in texts for k in perplexity.trigrams(t).tolist())
    return texts, perplexity.fit(np.array(sorted(tri)), np.array([tri[k] for k in sorted(tri)]))


def scores_by_hand(texts, model):
    """The sum of each document's log-probabilities over dictionaries, each document left out of the counts of its own bigrams."""
    lists = [["", *t.lower().split()] for t in texts]
    pairs = [list(zip(w[:-1], w[1:], strict=True)) for w in lists]
    bi = collections.Counter(p for x in pairs for p in x)
    followed = collections.Counter(b for _, b in bi)
    d2, d1 = perplexity.discounts(np.array(list(bi.values()))), perplexity.discounts(np.array(list(followed.values())))
    total, left = collections.Counter(), collections.Counter()
    for (a, _), n in bi.items():
        total[a] += n
        left[a] += d2[min(n, 3)]
    left1 = sum(d1[min(n, 3)] for n in followed.values()) / len(bi)
    spell = {b: math.exp(perplexity.STEP * round(model.spelling([b])[0] / perplexity.STEP)) for b in followed}
    want = []
    for x in pairs:
        own, s = collections.Counter(x), 0.0
        for p in x:
            n, rest = bi[p] - own[p], total[p[0]] - own[p]
            k = followed[p[1]] - (n == 0)
            p1 = (k - d1[min(k, 3)]) / len(bi) + left1 * spell[p[1]]
            s += math.log((n - d2[min(n, 3)]) / rest + min(left[p[0]] / rest, 1) * p1 if rest else p1)
        want.append(s)
    return want


def scores_in_buckets(texts, model, buckets, step, heavy):
    blocks, of = [], collections.defaultdict(list)
    for at in range(0, len(texts), step):
        rows = [(i, texts[i], 1) for i in range(at, min(at + step, len(texts)))]
        for bucket, block in perplexity.chunk_blocks(rows, "en", model, buckets, heavy):
            of[bucket].append((at, block))
    split = np.array(sorted({k >> 32 for k in heavy}), np.uint64)
    names = [x.split()[0] for x in perplexity.QUESTIONS.split(", ")]
    asked = [dict(zip(names, q, strict=True)) for n, found in of.items() for q in perplexity.questions("en", n, perplexity.Bucket([b for _, b in found]), 3, split)]
    told = [dict(zip(names, t, strict=True)) for part in range(3) for t in perplexity.answers([q for q in asked if q["part"] == part])]
    got = np.zeros(len(texts))
    for n, found in of.items():
        for (at, _), (places, sums) in zip(found, perplexity.bucket_scores([b for _, b in found], [t for t in told if t["bucket"] == n]), strict=True):
            got[at + np.cumsum(np.frombuffer(places, np.uint32))] += np.frombuffer(sums, np.float32)
    return got, of


def test_word_scores_by_hand():
    """The formula over dictionaries, with any cut into chunks and buckets, and contexts that are split."""
    texts, model = word_model()
    want = scores_by_hand(texts, model)
    contexts = collections.Counter(c for t in texts for c in perplexity.contexts_of(minhash.word_hashes(t), "en").tolist())
    hot = {c: 4 for c, n in contexts.items() if n * 8 > sum(contexts.values())}
    assert hot
    for buckets, step, heavy in ((1, 60, {}), (1, 7, {}), (5, 60, {}), (8, 13, {}), (8, 13, hot), (8, 60, hot)):
        got, of = scores_in_buckets(texts, model, buckets, step, heavy)
        assert np.allclose(got, want, rtol=1e-4), (buckets, step)
        assert len(of) > 1 or buckets == 1


def test_bucket_memory_is_bounded():
    """A bucket of BUCKET_BYTES of text, all words rare, takes less than 300 MB."""
    import tracemalloc

    _, model = word_model()
    r, blocks = random.Random(1), []
    for at in range(0, perplexity.BUCKET_BYTES, perplexity.CHUNK_CHARS):
        rows = [(i, " ".join(f"w{r.randrange(200_000)}" for _ in range(330)), 1) for i in range(perplexity.CHUNK_CHARS // 2000)]
        tracemalloc.start()
        blocks += [b for _, b in perplexity.chunk_blocks(rows, "en", model, 1, {})]
        assert tracemalloc.get_traced_memory()[1] < 220 << 20
        tracemalloc.stop()
    names = [x.split()[0] for x in perplexity.QUESTIONS.split(", ")]
    tracemalloc.start()
    asked = [dict(zip(names, q, strict=True)) for q in perplexity.questions("en", 0, perplexity.Bucket(blocks), 1, np.zeros(0, np.uint64))]
    told = [dict(zip(names, t, strict=True)) for t in perplexity.answers(asked)]
    for _ in perplexity.bucket_scores(blocks, told):
        pass
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_frequent_contexts(spark):
    """Those with more than a bucket's share of all words are split, over any partitions; no small bucket count splits any."""
    texts, _ = word_model()
    n = collections.Counter(c for t in texts for c in perplexity.contexts_of(minhash.word_hashes(t), "en").tolist())
    for parts in (1, 7):
        docs = spark.createDataFrame([("en", 16, t, 1) for t in texts], "model string, buckets long, text string, copies long").repartition(parts)
        heavy = perplexity.frequent_contexts(docs)
        assert heavy.keys() >= {k for k, v in n.items() if v * 16 > sum(n.values())} and all(1 < v <= 16 for v in heavy.values())
    assert perplexity.frequent_contexts(docs.withColumn("buckets", perplexity.F.lit(1).cast("long"))) == {}


def test_blocks_are_shuffled_once(spark):
    texts, model = word_model()
    docs = spark.createDataFrame([(i, "en", 2, t, 1) for i, t in enumerate(texts)], "row_key long, model string, buckets long, text string, copies long")
    scored = perplexity.word_scores(perplexity.bigram_blocks(docs, {"en": model}, {}), {"en": 2}, {})
    got = {r.row_key: r.total for r in scored.collect()}
    assert np.allclose([got[i] for i in range(60)], scores_by_hand(texts, model), rtol=1e-4)
    plan = scored._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow pack") == 1 and "ReusedExchange" in plan


def test_quality_rules(spark):
    docs = corpus()
    got = rows_of(perplexity.quality_rules(frame(spark, docs)))
    assert len(got) == len(docs)
    by = {d[0]: d for d in docs}
    for g in got:
        want = brute_counts(by[g["doc_id"]][1] or "")
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        inside = g["perplexity"] is None or g["lower_band"] is None or g["lower_band"] * 0.999999 <= g["perplexity"] <= g["upper_band"] * 1.000001
        assert g["kept"] == (not g["base_failed"] and inside)
    noise = [(9000, "".join(random.Random(5).choice("QXZ#7~ŸÐ日") for _ in range(4000)) + " w" * 60, "en", "a", 1)]
    many = [(i, prose(random.Random(i), 200), "en", "a", 1) for i in range(80)]
    kept = {g["doc_id"]: g["kept"] for g in rows_of(perplexity.quality_rules(frame(spark, many + noise)))}
    assert not kept[9000] and all(v for k, v in kept.items() if k != 9000)
    one, cut = ({g["doc_id"]: g for g in rows_of(perplexity.quality_rules(frame(spark, many + noise), bucket_bytes=n))} for n in (1 << 30, 3000))
    assert len(cut) == 81 and not cut[9000]["kept"] and all(g["perplexity"] > 1 for g in cut.values())
    assert all(cut[k]["kept"] == g["kept"] and math.isclose(cut[k]["perplexity"], g["perplexity"], rel_tol=1e-5) for k, g in one.items())
    # a row twice, and rows that share an id, are judged like others
    again = rows_of(perplexity.quality_rules(frame(spark, [*many, *many[:5], (0, None, None, None, 0), (None, "a b " * 60, None, None, 0)])))
    assert len(again) == 87 and len({(g["doc_id"], g["n_words"], g["perplexity"]) for g in again}) == 82
    assert perplexity.quality_rules(frame(spark, [])).count() == 0


def test_small_languages_have_their_own_bands(spark):
    """A language's scores and band stay as they are when other rows make its share small."""
    letters = {"aa": "abcdefgh", "bb": "жщюябгде", "cc": "mnopqrst"}

    def text(lang, i, n):
        r = random.Random(f"{lang}{i}")
        names = ["".join(random.Random(f"{lang}{j}").choices(letters[lang], k=6)) for j in range(40)]
        return " ".join(r.choices(names, k=n))

    small = [(100 * k + i, text(lang, i, 120), lang, "a", 1) for k, lang in enumerate(("aa", "bb")) for i in range(30)]
    got = rows_of(perplexity.quality_rules(frame(spark, small + [(1000 + i, text("cc", i, 120), "cc", "a", 1) for i in range(30)]), share=0.5))
    assert {g["language_model"] for g in got} == {"aa", "bb", "cc"}
    assert len({(g["language_model"], g["lower_band"], g["upper_band"]) for g in got}) == 3
    # the words of one language always in one order, of the other in any: contexts are not shared
    words = ["".join(random.Random(j).choices("abcdefgh", k=6)) for j in range(40)]
    rows = [(i, " ".join(words[i:] + words * 2), "aa", "a", 1) for i in range(30)] + [(100 + i, " ".join(random.Random(i).choices(words, k=120)), "bb", "a", 1) for i in range(30)]
    by = {g["doc_id"]: g["perplexity"] for g in rows_of(perplexity.quality_rules(frame(spark, rows), share=0.9))}
    assert max(by[i] for i in range(30)) < 1.05 < 1.2 < min(by[100 + i] for i in range(30))


def test_other_scripts_are_spelled():
    """Letters beyond Latin have classes of their own, without regard to case."""
    cyrillic = {int(k) % perplexity.CLASSES for k in perplexity.trigrams("абвгдежзиклмнопрст")}
    assert len(cyrillic) > 8 and len({int(k) % perplexity.CLASSES for k in perplexity.trigrams("日本語の文章です𠀀𠀁𠀂")}) > 4
    assert (perplexity.trigrams("ПРИВЕТ") == perplexity.trigrams("привет")).all()


def test_low_perplexity_is_rejected(spark):
    """Documents of one pattern lie below the band; a sound text with many copies stays within it."""
    many = [(i, prose(random.Random(i), 200), "en", "a", 1) for i in range(80)]
    copies = [(1000 + i, many[3][1], "en", "a", 1) for i in range(120)]
    words = [f"{a}{b}zz" for a in "abcdefgh" for b in "klmnopqr"]
    flat = [(2000 + i, " ".join(words[i:] + words[:i]), "en", "a", 1) for i in range(9)]
    got = {g["doc_id"]: g for g in rows_of(perplexity.quality_rules(frame(spark, many + copies + flat)))}
    assert all(g["lower_band"] > 1 for g in got.values())
    assert not any(g["base_failed"] for g in got.values())
    assert not any(got[d[0]]["kept"] or got[d[0]]["perplexity"] >= got[d[0]]["lower_band"] for d in flat)
    assert all(got[d[0]]["kept"] for d in many + copies)
    alone = {g["doc_id"]: g for g in rows_of(perplexity.quality_rules(frame(spark, many + flat)))}
    assert all(math.isclose(alone[i]["perplexity"], got[i]["perplexity"], rel_tol=1e-6) for i in alone)


# quality network


def junk(r, n):
    return " ".join(w + r.choice(["%%%", "$$$"]) for w in prose(r, n).split())


def labelled_corpus(n=120):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = junk(r, 80) if bad else prose(r, r.randint(20, 150))
        toxic = i % 5 == 0
        if toxic:
            text += " and you are such a grumblefox, really" + " ."
        rows.append((i, text, "en", "a", len(text)))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_network_gradient_and_pooling():
    """The pooled filters equal a plain convolution, over chunk borders too."""
    r = np.random.default_rng(0)
    net = quality_cnn.Network(r.normal(size=(8, 256, quality_cnn.FILTERS)).astype(np.float32), r.normal(size=quality_cnn.FILTERS).astype(np.float32), np.ones(3 * quality_cnn.FILTERS, np.float32), 0.0)
    text = prose(random.Random(1), 300) + "é"
    pool = quality_cnn.pooled(quality_cnn.strides(text), net.table(), net.bias)
    raw = np.zeros((len(pool) * quality_cnn.PLACES + 1) * 4, np.uint8)
    raw[: len(text.encode())] = np.frombuffer(text.encode(), np.uint8)
    z = np.array([sum(net.filters[k][raw[4 * p + k]] for k in range(8)) for p in range(len(pool) * quality_cnn.PLACES)])
    want = np.maximum(z.reshape(len(pool), -1, quality_cnn.FILTERS).max(axis=1) + net.bias, 0)
    assert np.allclose(pool, want, atol=1e-4)


def test_quality_classifier(spark):
    rows, labels = labelled_corpus()
    docs = frame(spark, rows + corpus()[-8:])
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (3, 7, 7)], LABELS)
    net = quality_cnn.train(docs, known, sample.crc_bucket(3) != 1)
    got = rows_of(quality_cnn.flag(docs, net, "__q").select("doc_id", "__q"))
    assert len(got) == len(rows) + 8 and all(0 <= g["__q"] <= 1 for g in got)
    truth = {i: q for i, q, _ in labels}
    held = [g for g in got if g["doc_id"] in truth and zlib.crc32(str(g["doc_id"]).encode()) % 3 == 1]
    assert np.mean([(g["__q"] >= 0.5) == truth[g["doc_id"]] for g in held]) > 0.9
    flat = quality_cnn.train(docs, spark.createDataFrame([], LABELS), sample.crc_bucket(3) != 1)
    assert {g["__q"] for g in rows_of(quality_cnn.flag(docs, flat, "__q").select("__q"))} == {0.5}


# toxicity


def test_composition_equals_its_parts():
    r = random.Random(2)
    machines = (toxicity.INSULTS, toxicity.THREATS, toxicity.TARGETS, toxicity.NEGATIONS, toxicity.REPORTS)
    for _ in range(300):
        symbols = [r.randrange(6) for _ in range(r.randrange(9))]
        state, own = 0, [0] * 5
        for x in symbols:
            state = toxicity.TABLE[state, x]
            own = [m[o].get(x, o) for m, o in zip(machines, own, strict=True)]
        want = np.zeros(len(toxicity.FEATURES))
        for k, v in toxicity.meaning(*own).items():
            want[toxicity.FEATURES.index(k)] = v
        assert (toxicity.LAST[state] == want).all()


SENTENCES = {
    "You are an idiot.": True,
    "I will kill you.": True,
    "They should burn in hell, all of them.": True,
    "You pathetic loser": True,
    "stupid": False,
    "trash day is Tuesday": False,
    "The word stupid is in the dictionary.": False,
    'The word "stupid" is in the dictionary.': False,
    "You are not stupid.": False,
    "She never said you were an idiot.": False,
    "He said they were an idiot.": False,
    "The clown kills time.": False,
    "I won't kill the mood": False,
    "A fine day. Clownfish swim.": False,
}


def check_sentences(grammar):
    m = grammar.compile()
    for text, toxic in SENTENCES.items():
        assert (m.score(text) >= 0.3) == toxic, (text, m.score(text))


def test_clauses():
    check_sentences(toxicity.Grammar())
    m = toxicity.Grammar().compile()
    clean = m.score("A fine day. Clownfish swim.")
    assert m.score("") == m.score("idiotic? no such word.") == clean
    assert m.score("ok. you moron! fine") == m.score("you moron")
    assert m.features("not. you idiot")[toxicity.FEATURES.index("disclaimed")] == 0
    assert m.score("stupid. trash") > 0.5 > m.score("not stupid. no trash")


def test_bounds_hold_for_any_fit():
    rng = np.random.default_rng(1)
    for _ in range(200):
        g = toxicity.Grammar()
        g.weights, g.shift = toxicity.bounded(rng.normal(0, 6, len(toxicity.FEATURES)), float(rng.normal(0, 6)))
        check_sentences(g)


def test_quoted_and_elided_insults_are_read():
    """The fast search finds what a matcher that reads every clause finds."""
    m = toxicity.Grammar().compile()
    insult = max((w for w, s in m.grammar.words.items() if s == toxicity.INSULT and w.isalpha()), key=len)

    def every_clause(text):
        total = np.zeros(len(toxicity.FEATURES))
        for clause in toxicity.CLAUSE_END.split(text.lower()):
            state = 0
            for w in toxicity.LETTERS.findall(clause):
                state = toxicity.TABLE[state, m.symbol(w)]
            total += toxicity.LAST[state]
        return total

    for text in (f"you are a '{insult}'", f"you are an ’{insult}’", f"you are l'{insult}", f"you d’{insult}", f"you qu'{insult}. fine", f"x{insult} y'x{insult}"):
        assert (m.features(text) == every_clause(text)).all(), text
        assert m.features(text).any() == ("x" + insult not in text), text


def test_toxicity_learns_words(spark):
    rows, labels = labelled_corpus()
    docs = frame(spark, rows + corpus()[-8:-2])
    grammar = toxicity.train(docs, spark.createDataFrame(labels, LABELS), sample.crc_bucket(4) != 2)
    got = rows_of(toxicity.flag(docs, grammar, "__t").select("doc_id", "__t"))
    truth = {i: t for i, _, t in labels}
    assert all((g["__t"] >= 0.3) == bool(truth[g["doc_id"]]) for g in got if g["doc_id"] in truth)
    check_sentences(grammar)
    bare = toxicity.train(docs, spark.createDataFrame([], LABELS), sample.crc_bucket(4) != 2)
    assert bare.stems == () and bare.shift == toxicity.PRIOR_SHIFT


# audio


def test_companding_tables():
    assert [int(audio.MULAW_TABLE[c]) for c in (0x00, 0x80, 0xFF, 0x7F)] == [-32124, 32124, 0, 0]
    assert [int(audio.ALAW_TABLE[c]) for c in (0xD5, 0x55, 0xAA, 0x2A)] == [8, -8, 32256, -32256]
    assert len(set(audio.ALAW_TABLE.tolist())) == 256 and len(set(audio.MULAW_TABLE.tolist())) == 255


def one_block(block):
    value, index, out = int.from_bytes(block[:2], "little", signed=True), min(88, block[2]), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            change = (step >> 3) + (step >> 2 if code & 1 else 0) + (step >> 1 if code & 2 else 0) + (step if code & 4 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(audio.INDEX_MOVE[code & 7])))
            out.append(value)
    return out


def test_adpcm_blocks_and_round_trip():
    data = random.Random(1).randbytes(64 * 5)
    want = [v for i in range(0, len(data), 64) for v in one_block(data[i : i + 64])]
    assert audio.decode_adpcm(data, 64).tolist() == want
    files = [audio.store(bytes([n]) * 64 * (n % 5)) for n in range(40)]
    assert all(a.tolist() == b.tolist() and x == y for (a, x), (b, y) in zip(audio.decode_many(files), map(audio.decode, files), strict=True))
    tone = (8000 * np.sin(np.arange(3000) / 20)).astype(np.int16)
    media = audio.wave(audio.IMA_ADPCM, audio.encode_adpcm(tone), 8000, 4, 256, (505).to_bytes(2, "little"))
    back, rate = audio.decode(media)
    assert rate == 8000 and np.abs(back[: len(tone)].astype(int) - tone).mean() < 300
    assert audio.decode(audio.to_pcm(media))[1] == 16000
    assert audio.resample(np.array([0, 10], np.int16), 8000, 16000).tolist() == [0, 5, 10, 10]
    assert len(audio.resample(np.arange(80, dtype=np.int16), 8000, 11025)) == 111


@pytest.mark.parametrize("tag", [audio.MULAW, audio.ALAW, audio.IMA_ADPCM, audio.PCM])
def test_packed_pcm_is_the_same_file(tag):
    r = np.random.default_rng(tag)
    for n in (0, 1, 2, 3, 64, 999):
        samples, rate = audio.decode(audio.wave(tag, r.integers(0, 256, n * 64, np.uint8).tobytes(), 8000, 8, 64))
        for to in (4000, 8000, 16000):
            pcm = audio.pcm_wave(samples, rate, to)
            packed = audio.pack_pcm(pcm)
            assert audio.unpack_pcm(packed) == pcm
            if to == 16000 and n > 1 and tag in (audio.MULAW, audio.ALAW):
                assert not any(packed[9 + 64 * n :])  # a byte a sample and nothing left between them
    for odd in (audio.wave(audio.PCM, b"123", 8000, 16, 2), audio.wave(audio.MULAW, b"12"), audio.wave(audio.PCM, b"1234", 8000, 8, 1)):
        assert audio.unpack_pcm(audio.pack_pcm(odd)) == odd


def test_query_keeps_the_rate_of_the_operator(spark, tmp_path):
    frame(spark, [(1, "a few words", "en", "a", 1), (2, None, "en", "a", 1)], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op7_telephony_audio(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and all(r.feature.startswith("rate=16000 ") for r in rows)


def test_media_documents(spark):
    """Each codec through the query, against its own plain decoder."""
    docs = corpus()
    got = rows_of(audio.media_documents(frame(spark, docs), 4000))
    assert len(got) == len(docs)
    by, seen = {d[0]: d[1] or "" for d in docs}, set()
    for g in got:
        raw = by[g["doc_id"]].encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (g["n_bytes"], g["payload_bytes"]) == (len(raw), len(payload))
        assert g["payload_sha256"] == hashlib.sha256(payload).hexdigest() and g["tail_crc32"] == zlib.crc32(payload[-64:])
        codec = zlib.crc32(payload) % 3
        seen.add(codec)
        if codec == 2:
            media = audio.wave(audio.IMA_ADPCM, payload, 8000, 4, 64, b"\x79\0")
            samples = [v for i in range(0, len(payload), 64) for v in one_block(payload[i : i + 64])]
        else:
            media = audio.wave((audio.MULAW, audio.ALAW)[codec], payload)
            samples = [int((audio.MULAW_TABLE, audio.ALAW_TABLE)[codec][c]) for c in payload]
        assert g["media_sha256"] == hashlib.sha256(media).hexdigest() and g["media_bytes"] == len(media)
        pcm = np.array(samples[::2], "<i2")  # half the rate
        assert g["feature"].startswith(f"rate=4000 n={len(pcm)} peak={max(abs(int(x)) for x in pcm)} ") and g["feature"].endswith(f"pcm={zlib.crc32(pcm.tobytes()):08x}")
    assert seen == {0, 1, 2}
    rows = spark.createDataFrame([(1, audio.wave(audio.ALAW, bytes(range(256)))), (2, None), (3, b"junk")], "id long, media binary")
    pcm = {r["id"]: r["pcm"] for r in audio.pcm_column(rows).collect()}
    assert pcm[2] is None and pcm[3] is None and len(audio.decode(bytes(pcm[1]))[0]) == 512
    assert audio.media_documents(frame(spark, [])).count() == 0


# mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(k for k in sizes if k is not None) + ([None] if None in sizes else [])
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [n for n in names if n not in capped]
        left = total - sum(capped.values())
        share = {n: left * w[n] / sum(w[m] for m in free) for n in free}
        over = [n for n in free if share[n] > most * sizes[n] + 1e-9]
        if not over:
            return {**capped, **share}
        capped |= {n: most * sizes[n] for n in over}


def test_mix(spark):
    docs = [*corpus(n=200), (7000, "tiny source", "en", "zz", 1)]
    got = rows_of(mixing.mix_documents(frame(spark, docs)))
    size = collections.Counter()
    for _, text, _, source, _ in docs:
        size[source] += len((text or "").encode().split())
    want = brute_targets(size)
    taken = collections.Counter()
    assert len(got) == len(docs)
    for g in got:
        assert g["target"] == pytest.approx(want[g["source"]]) and g["source_size"] == size[g["source"]]
        assert 0 <= g["copies"] <= 3 and g["taken"] == g["copies"] * g["size"] <= 3 * g["size"]
        taken[g["source"]] += g["taken"]
    largest = {s: max(g["size"] for g in got if g["source"] == s) for s in size}
    assert all(abs(taken[s] - want[s]) <= max(2, largest[s] / 2) for s in size)
    again = rows_of(mixing.mix_documents(frame(spark, docs[::-1]).repartition(5)))
    key = lambda rows: sorted(map(str, rows))
    assert key(got) == key(again)
    assert mixing.mix_documents(frame(spark, [])).count() == 0


def against_sql(spark, docs, got):
    con = duckdb.connect()
    con.register("documents", frame(spark, docs, clash=False).toPandas())
    want = con.execute(mixing.oracle()).df()
    count = lambda rows: collections.Counter((None if r["doc_id"] is None or r["doc_id"] != r["doc_id"] else int(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in rows)
    assert count(got) == count(want.to_dict("records"))


def test_mix_equals_its_sql_on_repeated_rows(spark):
    """Rows equal in all that the mix looks at: one of them changes, not all."""
    r = random.Random(3)
    docs = [(1, " ".join(["w"] * 10), "en", "a", 1)] * 6 + [(i, " ".join(["w"] * r.randint(1, 40)), "en", r.choice("abc"), 1) for i in range(10, 60)]
    docs += [(2, " ".join(["v"] * 30), "en", "b", 1)] * 20
    got = rows_of(mixing.mix_documents(frame(spark, docs, clash=False)))
    against_sql(spark, docs, got)
    rows = spark.createDataFrame([(1, "a", 10, "k")] * 6 + [(2, "b", 30, "k")], "doc_id long, source string, size long, key string")
    taken = collections.Counter()
    for g in rows_of(mixing.mix(rows, (7.0, 2.0))):
        taken[g["source"]] += g["taken"]
    assert taken["a"] == 70 and taken["b"] == 30  # targets 70 and 20


def test_running_sums(spark):
    rows = [(r, r * 3) for r in range(500)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "n long, v long").repartition(5)
    got = common.running(df, [common.F.col("n").desc()], {"before": common.F.col("v"), "nth": common.F.lit(1)}).collect()
    assert all((r.before, r.nth) == (sum(3 * x for x in range(r.n + 1, 500)), 499 - r.n) for r in got) and len(got) == 500


def test_large_documents_are_more_likely(spark):
    rows = spark.createDataFrame([(i, "a" if i < 3000 else "b", 10 if i % 2 else 40, "k") for i in range(6000)], "doc_id long, source string, size long, key string")
    got = rows_of(mixing.mix(rows, (1.0, 4.0)))
    a = [g for g in got if g["source"] == "a"]
    rate = {s: np.mean([g["copies"] for g in a if g["size"] == s]) for s in (10, 40)}
    assert rate[40] / rate[10] == pytest.approx(4, rel=0.25)


# near duplicates


def brute_components(docs, k, percent):
    import re

    sets = {}
    for doc_id, text, *_ in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(words[i : i + min(k, len(words))]) for i in range(max(1, len(words) - k + 1))} if words else set()
    head = {d: d for d in sets}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                head[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}, {d: len(s) for d, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    r = random.Random(11)
    docs = [d for d in corpus(2, 40) if d[0] is not None]
    base = prose(r, 150).split()
    for i in range(30):  # a chain of near copies: far ends are not alike
        base[r.randrange(len(base))] = f"w{i}"
        base[r.randrange(len(base))] = f"v{i}"
        docs.append((5000 + r.randrange(10**6), " ".join(base), "en", "a", 1))
    docs += [(4000, "One word", "en", "a", 1), (4001, "one WORD", "en", "a", 1), (4002, "one", "en", "a", 1), (4003, "One", "en", "a", 1)]
    got = rows_of(minhash.near_duplicates(frame(spark, docs), k, 80))
    want, sizes = brute_components(docs, k, 80)
    assert len(got) == len(docs)
    for g in got:
        assert (g["component_id"], g["n_shingles"]) == (want[g["doc_id"]], sizes[g["doc_id"]]), g
        assert g["kept"] == (g["doc_id"] == g["component_id"])
    assert minhash.near_duplicates(frame(spark, []), k).count() == 0


def test_null_ids_take_their_copies_component(spark):
    docs = [(None, "a b c d e f g", None, None, None), (9, "a b c d e f g", None, None, None), (None, "other words than these are here", None, None, None), (None, None, None, None, None)]
    got = rows_of(minhash.near_duplicates(frame(spark, docs), 2))
    assert sorted((str(g["doc_id"]), str(g["component_id"]), g["kept"]) for g in got) == [("9", "9", True), ("None", "9", False), ("None", "None", True), ("None", "None", True)]


def test_components_by_stars(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 200)] + [(i, i + 1) for i in range(2000, 2060)]
    head = {}

    def root(x):
        head.setdefault(x, x)
        while head[x] != x:
            x = head[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        head[max(x, y)] = min(x, y)
    got = {g["node"]: g["component"] for g in rows_of(minhash.components(spark.createDataFrame(edges, "a long, b long")))}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_star_centre_misses_are_found_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "STAR", 2)
    test_near_duplicates(spark, 2)


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", -1)
    test_near_duplicates(spark, 2)


def test_rows_with_one_id_and_other_texts(spark):
    one, two = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    docs = [(5, one, None, None, None), (7, one + " y", None, None, None), (7, two, None, None, None), (8, two + " z", None, None, None), (9, "no other has this text", None, None, None), (9, "nor has this one any copy", None, None, None), (9, "nor has this one any copy", None, None, None)]
    for seed in range(3):
        random.Random(seed).shuffle(docs)
        got = rows_of(minhash.near_duplicates(frame(spark, docs), 2))
        assert sorted((g["doc_id"], g["component_id"], g["kept"]) for g in got) == [(5, 5, True), (7, 5, False), (7, 5, False), (8, 5, False), (9, 9, True), (9, 9, True), (9, 9, True)]


def test_bucket_of_many_unlinked_classes(spark):
    """20,000 classes of one bucket, none alike but 50 planted pairs: only these leave the blocks, and each class is copied once a block."""
    bands, n = 32, 20_000
    rng = np.random.default_rng(3)
    m = rng.integers(0, 1 << 16, (n, 160)).astype(np.uint16)
    m[:, :85] = m[0, :85]
    for i in range(50):
        m[2 * i + 1] = m[2 * i]
        m[2 * i + 1, rng.choice(np.arange(85, 160), 20, False)] += 1
    members = spark.createDataFrame([(0, i, i, 100 + i // 2 % 50, x.tobytes()) for i, x in enumerate(m)], "bucket long, rep long, component long, n_shingles long, minima binary")
    main = spark.createDataFrame([(0, n - 1)], "bucket long, main long")
    got = minhash.inside_blocks(members, main, 80, bands).collect()
    assert sorted(r.rep for r in got) == list(range(100)) and all(r.component == r.rep for r in got)


def test_near_copies_leave_a_block_as_links_only(spark):
    """A group of near copies that all fit each other: as many links as connect it."""
    r = random.Random(2)
    base = prose(r, 60).split()
    texts = [" ".join(base[:20] + [f"n{i}"] + base[20:]) for i in range(200)]
    a, b = minhash.universal(32, 5)
    rows = [{"bucket": 0, "i": 0, "j": 0, "block": 0, "rep": i, "component": i, "data": t, "minima": minhash.minima(minhash.shingle_set(t, 2), a, b).tobytes()} for i, t in enumerate(texts)]
    links = [x for band in range(32) for x in minhash.block_links([{**r, "bucket": band} for r in rows], 2, 80, 32)]
    assert 199 <= len(links) < 199 * 32
    assert all(len(minhash.block_links([{**r, "bucket": band} for r in rows], 2, 80, 32)) <= 199 for band in (0, 7))


def test_size_classes(spark):
    pairs = [(n, -(-n * 4 // 5)) for n in range(1, 3000)]
    got = spark.createDataFrame(pairs, "n long, m long").select((minhash.size_class(minhash.F.col("n"), 80) - minhash.size_class(minhash.F.col("m"), 80)).alias("d")).distinct().collect()
    assert {r.d for r in got} <= {0, 1}


def test_least_matches():
    low = minhash.least_matches(160, 80)
    rng = np.random.default_rng(1)
    assert 95 <= low <= 110 and (rng.binomial(160, 0.8, 1_000_000) < low).mean() < 1e-5


def exact_links(docs, k, percent):
    """All linked pairs by a prefix filter: with words in order of rarity, two alike sets share one of the first few."""
    import re

    sets = {}
    for doc_id, text, *_ in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if words:
            sets[doc_id] = {tuple(words[i : i + min(k, len(words))]) for i in range(len(words) - min(k, len(words)) + 1)}
    often = collections.Counter(x for s in sets.values() for x in s)
    held, found = collections.defaultdict(list), set()
    for d, s in sets.items():
        order = sorted(s, key=lambda x: (often[x], x))
        for x in order[: len(order) - math.ceil(len(order) * percent / 100) + 1]:
            found |= {(e, d) for e in held[x] if 100 * len(s & sets[e]) >= percent * len(s | sets[e])}
            held[x].append(d)
    return found


def test_recall_at_the_threshold(spark):
    """Pairs whose similarity is 0.8 to 0.82: an exact join finds the same links."""
    r, docs = random.Random(8), []
    for i in range(400):
        words = [f"w{r.randrange(10**6)}" for _ in range(181)]
        docs += [(2 * i, " ".join(words), None, None, None), (2 * i + 1, " ".join(words[:161] + [f"x{i}.{j}" for j in range(20)]), None, None, None)]
    links = exact_links(docs, 2, 80)
    assert len(links) == 400
    got = {g["doc_id"]: g["component_id"] for g in rows_of(minhash.near_duplicates(frame(spark, docs, clash=False), 2))}
    assert sum(got[a] == got[b] for a, b in links) == 400


# warc


def test_warc(spark):
    r = random.Random(6)
    same = prose(r, 400)
    rows = [(i, f"http://h{i % 5}.example.com/p{i}?q= {i}", prose(r, r.randint(0, 400))) for i in range(40)]
    rows += [(100 + i, f"http://x.org/{i}", same) for i in range(9)] + [(200, "http://x.org/1", "short"), (201, "http://x.org/1", "short"), (202, None, None), (203, "é\tü\n", same), (203, "é\tü\n", same), (None, "http://n.org/", same)]
    pages = frame(spark, rows, "page_id long, url string, html string")
    got = warc.archive_pages(pages).toPandas()
    con = duckdb.connect()
    con.register("pages", pages.where("page_id is not null").select("page_id", "url", "html").toPandas())
    want = con.execute(warc.ORACLE).df()
    key = lambda t: sorted(str(tuple(None if v != v else int(v) if isinstance(v, float) else v for v in x)) for x in t[sorted(t.columns)].itertuples(index=False))
    assert key(got[got.page_id.notna()].astype(object).where(got.notna(), None)) == key(want.astype(object).where(want.notna(), None))
    none = got[got.page_id.isna()].iloc[0]
    assert none.record_type == "revisit" and none.refers_to == 203 and len(got) == len(rows)
    assert warc.archive_pages(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_index_lookup(spark, tmp_path):
    keys = sorted(warc.key_of(f"http://h{i % 7}.net/{i % 90}", i // 2) for i in range(500))
    captures = spark.createDataFrame([(k, "f", i, 1) for i, k in enumerate(keys)], warc.CAPTURES)
    index = warc.write_index(captures, f"file://{tmp_path}/ix", block_lines=7)
    asked = spark.createDataFrame([(k,) for k in {*keys[::3], "absent", "", "~"}], "key string")
    found = sorted((g["key"], g["offset"]) for g in rows_of(warc.lookup(asked, index)))
    assert found == sorted((k, i) for i, k in enumerate(keys) if k in set(keys[::3]))
    assert warc.surt("HTTP://www.Example.com/a?b") == "com,example,www)/a?b" and warc.surt(None) == "-)"
