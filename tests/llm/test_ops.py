"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and
clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from gavel.llm import exact_dedup, jaccard, licenses, mixing, neighbours, packing, quality, sharding, tokens, url_filter
from gavel.llm.common import FOLD, WordHasher, shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, size long, row string, token string"
BASE = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark forest where nobody has ever been before him " * 3
UNICODE_SPACE = [chr(c) for c in (0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x2007, 0x200A, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000, 0x1C, 0x1F, 0xFEFF)]


def texts():
    rng = np.random.default_rng(1)
    words = ["w%d" % i for i in range(400)]
    out = [None, "", " \t\n", "One", "one", "ONE two", "É é", BASE, BASE.upper(), BASE + "x", "same", "same", "same", "long " * 60_000]
    out += [" ".join(rng.choice(words, rng.integers(1, 200))) for _ in range(60)]
    for i in range(30):  # near copies of one text
        w = ("alpha beta gamma delta " + " ".join("t%d" % k for k in range(160))).split()
        w[int(rng.integers(4, 150))] = f"edit{i}"
        out.append(" ".join(w))
    out += ["Licensed under CC BY 4.0. All rights reserved.", "GNU Lesser General Public License, version 2.1 or later", "cc by cc by\ngeneral   public-license"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 5}", len(t or ""), 7, 8, "r", "t") for i, t in enumerate(texts())]
    rows += [rows[8], rows[9], (None, "no id", "en", "s1", 5, 1, 1, "", "")]  # repeated rows, a null id
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


URLS = [None, "", "no scheme", "http://", "http://com/en/", "https://A.COM/en/x?q#f", "http://a.example.com/en/7817", "http://example.com/en/6", "http://notexample.net/de/8", "http://x.example.net/de/8/1", "http://example.net#/de/8", "http://org/es", "http://org/es/", "a://b://com/en/", "http://x.CASINO-win.example.com/", "http://com.com/en/", "http://casinos.example.com/", "http://bets.net/de/1", "http://pills.org?x"]


def judged_url(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = lower(host)
    fits = [(k, v) for k, v in url_filter.RULES if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith("/" + k.split("/", 1)[1])]
    rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, None)
    return host, path, rule, verdict or ("block" if set(re.split("[.-]", host)) & set(url_filter.SPAM_WORDS) else "allow")


CLASH = "_id, _none, _keys, _rule, _p, _label, row, host, rule, keys, bits, uid, digest, bucket, taken, score, name"


def clashing(df):
    """The frame with a column for each of these names, holding the name."""
    return df.select("*", *[F.lit(n).alias(n) for n in CLASH.split(", ") if n not in df.columns])


def same_columns(before, after):
    assert after.columns == before.columns
    for r in after.collect():
        assert all(r[n] == n for n in CLASH.split(", ") if n not in SCHEMA)


def test_url_filter(spark):
    pages = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(3, URLS[4])], "page_id long, url string"))
    rules = url_filter.listed_keys(spark, url_filter.RULES).union(url_filter.spam_hosts(pages))
    for max_bits in (url_filter.MAX_BITS, 16):  # with few bits, each class is divided into several cascades
        got = url_filter.url_filter(pages, rules, max_bits=max_bits).collect()
        assert Counter((r.row.url, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((u, *judged_url(u)) for u in [*URLS, URLS[4]])
        assert all(r.row[n] == n for r in got for n in CLASH.split(", "))
    assert url_filter.url_filter(pages.where("false"), rules).count() == 0
    assert url_filter.url_filter(pages, rules.where("false")).where("rule is null and verdict = 'allow'").count() == len(URLS) + 1
    odd = url_filter.listed_keys(spark, [("com/en/", "o'clock"), ("com/en/", "allow"), ("com/en/", "block"), (None, "x")])
    kept = url_filter.url_filter(pages.withColumnRenamed("host", "url2").withColumn("host", F.col("url")), odd, url="host", rank=("block", "allow"))
    assert {(r.rule, r.listed, r.verdict) for r in kept.where("startswith(path, '/en/') and rule is not null").collect()} == {("com/en/", "com/en/", "allow")}


def test_cascade_is_exact(spark):
    from gavel.llm.common import Workspace

    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("substr(key, -2) = '07'")
    cascade = url_filter.Cascade(Workspace(spark, "t"), universe, listed, 200)  # a bound far too small: false positives
    df, sql = cascade.attach(universe, "b")
    assert len(cascade.levels) > 1
    found = df.withColumn("is", F.expr(f"filter(array(key), c -> {sql})")).where("size(is) = 1").select("key")
    assert found.exceptAll(listed).count() == 0 and listed.exceptAll(found).count() == 0


def test_exact_dedup(docs, pairs, nothing):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[lower(t)].append(i)
    top = {x: max((i for i in ids if i is not None), default=None) for x, ids in groups.items()}
    for widths in (exact_dedup.WIDTHS, (2, 3)):
        got = exact_dedup.exact_dedup(docs.where("length(coalesce(text, '')) < 9999") if widths == (2, 3) else docs, widths=widths).collect()
        want = Counter((i, top[lower(t)], len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in pairs if widths != (2, 3) or len(t or "") < 9999)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter({r.text_sha256: 1 for r in got})
    kept = exact_dedup.drop_exact_copies(clashing(docs))
    same_columns(clashing(docs), kept)
    assert Counter((r.doc_id, lower(r.text)) for r in kept.collect()) == Counter((top[x], x) for x in groups)
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.drop_exact_copies(nothing).count() == 0


def test_quality(spark, docs, nothing):
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(["plain", "words", "stand", "here"], 40)) for _ in range(80)]
    bad = [" ".join(x + "###" for x in t.split()) for t in good]
    both = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160)] + [(1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(both, labels)
    rows = quality.classify(both, model).select("row.doc_id", "score").collect()
    held = [r for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 10 and all((r.score >= 0.3) == (r.doc_id < 80) for r in held)
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 161
    same_columns(clashing(docs), quality.keep_good(clashing(docs), labels.where("false")))
    assert quality.keep_good(nothing, labels).count() == 0 and quality.keep_good(docs, labels.where("false")).count() == docs.count()


def test_quality_goes_on_after_a_long_text(spark):
    rows = [(i, "plain words stand here" if i % 2 else "### @@ ### @@", i % 2) for i in range(200)]
    known = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    first = known.where(~quality.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).first().doc_id
    long = known.withColumn("text", F.when(F.col("doc_id") == first, F.repeat("text", F.lit(10_000))).otherwise(F.col("text")))
    kept = quality.classify(long, quality.fit(long, long, max_bytes=20_000)).where("score >= 0.5").select("row.doc_id").collect()
    assert {r[0] for r in kept} - {first} == {i for i in range(1, 200, 2)} - {first}
    with pytest.raises(ValueError, match="label 0"):
        quality.fit(known.withColumn("text", F.when(F.expr("quality = 0"), F.repeat("text", F.lit(10_000))).otherwise(F.col("text"))), known, max_bytes=20_000)


def test_mixing(docs, pairs, nothing):
    out, slots = mixing.mix(docs, block=16)
    rows = out.collect()
    sizes, source = defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(words(t))) for i, t in pairs)
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
            free.discard(s)
    want |= share
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * r.target + 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 64 for s in names)
    assert Counter(map(tuple, mixing.mix(docs, block=16)[0].collect())) == Counter(map(tuple, rows))
    assert slots.groupBy("rank", "index").count().agg(F.max("count")).first()[0] <= 2
    assert mixing.mix(nothing)[0].count() == 0
    same_columns(clashing(docs), mixing.mixed_documents(clashing(docs)))


def test_deal_is_multinomial_and_exact(spark):
    from gavel.llm.common import Workspace

    quota = spark.createDataFrame([(i, 50 + i, n) for i, n in enumerate([30_000, 10_000, 300, 7, 0] + [5] * 200)], "rank int, blocks long, slots long")
    total = 30_000 + 10_000 + 300 + 7 + 1000
    got = mixing.deal(quota, total, 3, Workspace(spark, "t")).collect()
    assert sorted(r.slot for r in got) == list(range(total))
    draws = defaultdict(list)
    for r in got:
        draws[r.rank].append(r.draw)
    assert {k: sorted(v) for k, v in draws.items()} == {r.rank: list(range(r.slots)) for r in quota.collect() if r.slots}
    per = Counter((r.shard, r.rank) for r in got)
    first = [per[s, 0] for s in range(total // 1024)]
    p = 30_000 / total
    assert 0.4 < np.var(first) / (1024 * p * (1 - p)) < 2.2  # as draws with replacement have


def test_mixing_divides_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    docs = spark.range(2000).selectExpr("if(id < 700, null, id) as doc_id", "if(id < 700, 'same text of words', repeat('w ', cast(id % 90 as int))) as text", "'s' as source")
    rows = mixing.mix(docs, most=1.2)[0].collect()
    assert len(rows) == 2000 and abs(sum(r.taken for r in rows) - rows[0].target) <= 0.02 * rows[0].target and all(0 <= r.taken <= 2 * r.size for r in rows)


def test_mixed_words_meet_targets(spark):
    """Documents of many blocks: whole copies bring each source's words near its target, whatever the ratio."""
    docs = spark.range(1200).selectExpr("id as doc_id", "repeat('w ', cast(640 + id * 7919 % 1500 as int)) as text", "concat('s', id % 3) as source")
    want = {r.source: (r.source_size, r.target) for r in mixing.mix(docs, factor=0.6)[0].select("source", "source_size", "target").distinct().collect()}
    got = dict(mixing.mixed_documents(docs, factor=0.6).groupBy("source").agg(F.sum(mixing.word_count(F.col("text")))).collect())
    assert sorted(t / n for n, t in want.values()) == pytest.approx([0.225, 0.45, 1.125], abs=0.01)
    assert all(abs(got[s] - t) <= 0.03 * t for s, (_, t) in want.items())


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted("id", f"{n}L", "3")).collect()]
        assert sorted(got) == list(range(n))
    assert got != sorted(got)


def test_licenses(docs, pairs, nothing):
    assert len(licenses.signature_rules()) > 200
    rows = defaultdict(list)
    for r in licenses.license_scan(docs).collect():
        rows[r.doc_id].append(r)
    for i, t in pairs:
        r = rows[i][0]
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(w), len(places)) and 0 <= r.score <= 1
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert all(0 <= a.first_word < a.end_word <= r.n_words for a in r.detections)
    lesser = licenses.Scanner(licenses.signature_rules(), []).scan(b"GNU Lesser General Public License, version 2.1")[2]
    assert {d[2] for d in lesser} == {"lgpl-2.1"}
    assert licenses.license_scan(nothing).count() == 0


def test_sharding(docs, pairs, nothing):
    got = sharding.histogram_shards(docs, shards=4, per_shard=3).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in pairs)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    order = [r.text_crc32 for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)  # shards and slots follow the keys: equal texts stand together
    some = docs.where("length(coalesce(text, '')) < 9999")
    sums = [r[1] for r in sharding.histogram_shards(some, shards=4).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sums) == 4 and max(sums) - min(sums) <= 2 * 1500
    hot = docs.sparkSession.range(4000).select("id", F.lit("copy").alias("text"))  # one group of equal texts is split by id
    assert {r[1] for r in sharding.histogram_shards(hot, shards=4, doc_id="id").groupBy("shard").count().collect()} == {1000}
    assert sharding.histogram_shards(nothing).count() == 0


@pytest.mark.parametrize("width, num", [(3, 90), (5, 80)])
def test_jaccard(docs, pairs, nothing, width, num, monkeypatch):
    def shingles(t):
        w = words(lower(t))
        return {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}

    sets = [(i, shingles(t)) for i, t in pairs]
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                up[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = Counter((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets))
    for block in (512, 8):  # with the smaller one, families are searched in blocks
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "PIVOTS", 2)
        got = jaccard.jaccard_components(docs, width, num, 100)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want
    assert jaccard.jaccard_components(nothing).count() == 0
    kept = jaccard.keep_one_of_each(clashing(docs), width=width, num=num, den=100)
    same_columns(clashing(docs), kept)
    first = {min((k for k in range(len(sets)) if find(k) == find(j)), key=lambda k: (sets[k][0] is None, sets[k][0] or 0)) if sets[j][1] else j for j in range(len(sets))}
    stays = {sets[k][0] for k in first}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in sets if i in stays)


def test_link_equals_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 40, 60)
    sets = [np.unique(np.where(rng.random(60) < 0.06, rng.integers(0, 1 << 40, 60), base)) for _ in range(80)] + [np.unique(rng.integers(0, 99, n)) for n in (1, 2, 30, 30)]
    found = jaccard.link(sets, 80, 100)
    up = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = up[a], up[b]
                up = [min(x, y) if u in (x, y) else u for u in up]
    assert found == up and len(set(found)) > 3


def test_word_hashes_do_not_depend_on_place():
    h = WordHasher()
    h.STRETCH = 64
    data = ("ab cd\x0bef " * 40 + "x" * 300 + " ab").encode()
    got, one = h(data), WordHasher()
    assert got.tolist() == [one(w)[0] for w in data.split()] and got[0] == got[-1]
    assert len(shingle_set(one(b"A b".translate(FOLD)), 3)) == 1 and len(shingle_set(one(b" "), 3)) == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 12)).astype(np.float32).astype(float)
    x[100:160] = x[100]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [None] * 12), (1004, [1.0]), (None, [1.0] * 12), (20, x[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(df, lambda i: i % 20 == 0, k=20, cells=9).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r.rank))
    hit = 0
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        hit += len(set(best) & {f[0] for f in found})
        assert [f[2] for f in found] == list(range(1, 21)) and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(f[1] - s[f[0]]) < 1e-9 for f in found)
    assert hit >= 0.9 * 20 * len(got)
    few = neighbours.nearest_neighbours(df.where("vec_id in (0, 1, 2)"), lambda i: i % 20 == 0)
    assert few.count() == 2 and neighbours.nearest_neighbours(df.where("false"), lambda i: i % 20 == 0).count() == 0


def brute_nearest(rows, queries, k):
    """{query: [(id, score)]} of (id, vector) rows: each id once, by its best score, ties by id."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for q in queries:
        best = {}
        for v in x[ids == q]:
            for i, s in zip(ids, x @ v):
                if i != q:
                    best[i] = max(s, best.get(i, -np.inf))
        out[q] = sorted(best, key=lambda i: (-round(best[i], 9), i))[:k]
    return out


def found_nearest(df, is_query, **options):
    out = defaultdict(list)
    for r in neighbours.nearest_neighbours(df, is_query, **options).orderBy("query_id", "rank").collect():
        out[r.query_id].append(r.vec_id)
    return out


def test_neighbours_smallest_ids_of_copies(spark):
    """1500 copies in 75 partitions, more than the rerank keeps: the smallest ids win."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 12))
    x[500:] = x[500]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(2000), x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(75)
    asked = {rows[i][0] for i in (500, 900, 1999)} | {rows[int(np.argsort(-(x[:500] @ x[500]))[0])][0]}
    got = found_nearest(df, lambda i: i.isin(*asked), k=20, cells=1)
    assert got == brute_nearest(rows, asked, 20)


@pytest.mark.parametrize("same", [True, False])
def test_neighbours_counts_an_id_once(spark, same):
    """Each id three times, with equal vectors or close ones: still k ids."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 12))
    rows = [(i, (v + (0 if same else 0.01 * c)).tolist()) for c in range(3) for i, v in enumerate(x)]
    rows += [(7, x[3].tolist())] * 40 + [(i, x[3].tolist()) for i in range(300, 340)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found_nearest(df, lambda i: i.isin(0, 3, 20), k=20, cells=1)
    assert {q: len(f) for q, f in got.items()} == {0: 20, 3: 20, 20: 20} and got == brute_nearest(rows, (0, 3, 20), 20)


def test_packing(docs, pairs, nothing):
    rows = packing.best_fit(docs, capacity=100, group_rows=40).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
    for b in bins.values():
        assert sum(r.n_words for r in b) <= 100 and len({r.source for r in b}) == len(b) == len({r.cluster for r in b})
        at = 0
        for r in sorted(b, key=lambda r: r.position):
            assert r.start_word == at
            at += r.n_words
    per = Counter()
    for r in rows:
        per[r.doc_id] += r.n_words
    want = Counter()
    for i, t in pairs:
        want[i] += len(words(t))
    assert per == +want and packing.best_fit(nothing).count() == 0


def test_pack_takes_the_tightest_compatible_bin():
    assert packing.pack([6, 5, 4, 3], ["a", "b", "a", "c"], [1, 2, 3, 4], 10) == [0, 1, 1, 0]
    rng = np.random.default_rng(5)
    sizes, sources, clusters = rng.integers(1, 50, 200).tolist(), rng.integers(0, 6, 200).tolist(), rng.integers(0, 90, 200).tolist()
    got, open_bins = packing.pack(sizes, sources, clusters, 60), []
    for i in sorted(range(200), key=lambda i: -sizes[i]):
        fit = [(60 - sum(sizes[j] for j in b), n) for n, b in enumerate(open_bins) if sum(sizes[j] for j in b) + sizes[i] <= 60 and all(sources[j] != sources[i] and clusters[j] != clusters[i] for j in b)]
        n = min(fit)[1] if fit else len(open_bins)
        if n == len(open_bins):
            open_bins.append([])
        open_bins[n].append(i)
        assert got[i] == n


def test_tokens(spark, docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = ["a<|endoftext|>b <|startoftext|>", "it's WE'LL 12345 x", "e\u0301 \u0301x \u0301", "ΑΣ ΑΣ\u00a0Σ İ", *[f"ab{c}cd {c}{c}'s" for c in UNICODE_SPACE], "\u0000 a"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    for r in tokens.count_tokens(df, path).join(df, "doc_id").collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 2048), repr(r.text)[:80]
    assert tokens.count_tokens(nothing, path).count() == 0


@pytest.mark.parametrize("limits", [{"BLOCK_DOCS": 3}, {"BLOCK_CHARS": 40}, {"STRETCH": 30, "COMMON_DOCS": 0}, {"REMEMBERED": 5}, {"REMEMBERED_CHARS": 9, "BUCKETS": 1}])
def test_tokens_in_blocks(spark, docs, monkeypatch, limits):
    """Counts depend neither on blocks and stretches nor on which pre-tokens are common."""
    path = public_tokenizers.path("word_bpe_49k.json")
    some = docs.where("length(coalesce(text, '')) < 9999").union(docs.sparkSession.createDataFrame([(2000, "漢字" * 30 + " one\x1ctwo " * 9, *[None] * 7)], SCHEMA))
    want = Counter(map(tuple, tokens.count_tokens(some, path).collect()))
    for name, value in limits.items():
        monkeypatch.setattr(tokens, name, value)
    assert Counter(map(tuple, tokens.count_tokens(some, path).collect())) == want
